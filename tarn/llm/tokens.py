"""Byte-level BPE ids of many texts, each distinct piece between word breaks encoded once.

The pre-tokeniser of the vocabulary never joins characters across certain places: before a plain space that
is followed by something other than white space, around a single line end between other characters, and
between an ASCII letter and an ASCII mark other than an apostrophe.  Texts are cut there, pieces are hashed in
vectorised passes, and only pieces not seen by this worker lately are encoded.  Printable pieces go to
tiktoken's merge loop, which is several times faster, over ranks read from the same vocabulary file; all
others, and any that hold a special token, go to the tokenizers library.  The ids are those that the tokenizers
library gives for the whole text (a test holds one against the other).
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from tarn.llm import flat

#: Distinct pieces that a worker remembers, and how many new ones are gathered before they are sorted in.
REMEMBERED, GATHERED = 2_000_000, 100_000

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that are plainly not white space: ASCII but white space, and leads of characters that never are.
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = False
_SOLID[0x80:0xC0] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_SOLID_ASCII = _SOLID.copy()
_SOLID_ASCII[0x80:] = False
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
#: Pieces whose characters both libraries class alike: ASCII from the space on, and letters of Latin scripts.
_PRINTABLE = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others shifted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Of one worker; made anew in each Python process."""

    made: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.fast = None
        if self.cuts:
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.forget()

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in cls.made:
            cls.made[vocabulary] = cls(vocabulary)
        return cls.made[vocabulary]

    def forget(self) -> None:
        self.names, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def _ids(self, pieces: list[str], special: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        slow = []
        for k, piece in enumerate(pieces):
            if _PRINTABLE.fullmatch(piece) and not (special and any(t in piece for t in special)):
                out[k] = self.fast(piece)
            else:
                slow.append(k)
        for k, got in zip(slow, self.tokenizer.encode_batch_fast([pieces[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = got.ids
        return out

    def _learn(self, names: list[int], pieces: list[str], special: list[str]) -> None:
        ids = self._ids(pieces, special)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, total)
        first = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.new.update(zip(names, (first << 28 | sizes).tolist(), strict=True))
        if len(self.new) > GATHERED:
            names_, where = np.fromiter(self.new.keys(), np.uint64, len(self.new)), np.fromiter(self.new.values(), np.int64, len(self.new))
            names_, where = np.concatenate([self.names, names_]), np.concatenate([self.where, where])
            order = np.argsort(names_)
            self.names, self.where, self.new = names_[order], where[order], {}

    def _find(self, every: np.ndarray, piece, special: list[str]) -> np.ndarray:
        """Where the ids of each distinct piece lie, learning what is not known; piece(k) is the k-th one's text.

        special: the special tokens that occur in any of them.
        """
        held = np.full(len(every), -1, np.int64)
        if len(self.names):
            order = np.argsort(every)  # so that the search goes through the names from front to back
            line = every[order]
            at = np.minimum(np.searchsorted(self.names, line), len(self.names) - 1)
            known = self.names[at] == line
            held[order[known]] = self.where[at[known]]
        open_ = np.flatnonzero(held < 0)
        names = every[open_].tolist()
        held[open_] = [self.new.get(h, -1) for h in names]
        open_ = np.flatnonzero(held < 0)
        if len(open_):
            names = every[open_].tolist()
            self._learn(names, [piece(k) for k in open_.tolist()], special)
            if self.new:
                held[open_] = [self.new[h] for h in names]
            else:
                held[open_] = self.where[np.searchsorted(self.names, every[open_])]
        return held

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the n + 1 places where each text's ids begin."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        if not self.cuts:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate([np.array(x, np.int32) for x in ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
        letter, mark = _LETTER[data], _MARK[data]
        cut[1:n] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        line = np.flatnonzero((data[1:-1] == 0x0A) & _SOLID_ASCII[data[:-2]] & _SOLID[data[2:]]) + 1
        cut[line] = True
        cut[line + 1] = True
        for token in map(str.encode, self.special):
            k = raw.find(token)
            while k >= 0:
                cut[k + 1 : k + len(token)] = False
                k = raw.find(token, k + len(token))
        cut[at] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        coded = pa.array(flat.hashes(data, start, end)).dictionary_encode()  # by a hash table: no sort of all pieces
        which, every = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        place = np.empty(len(every), np.int64)
        place[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.names) + len(self.new) + len(every) > REMEMBERED:
            self.forget()
        special = [t for t in self.special if t.encode() in raw]
        begin, stop = start[place].tolist(), end[place].tolist()
        held = self._find(every, lambda k: raw[begin[k] : stop[k]].decode(), special)
        first, size = (held >> 28)[which], (held & ((1 << 28) - 1))[which]
        edge = np.concatenate([[0], np.cumsum(size)])
        out = self.pool[np.repeat(first - edge[:-1], size) + np.arange(edge[-1])]
        return out, edge[np.searchsorted(start, at)]
