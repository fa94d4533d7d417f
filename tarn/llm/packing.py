"""Retrieval packing: documents that belong together share a sequence.

Documents are dealt to shards by what they are about (see dealing), about SHARD_BYTES each.  A shard tokenises its documents and
builds a BM25 inverted index of their words; a seed asks with all of its words.  A seed document opens a window of 2048 tokens; the index
returns its unused neighbours, best first, and they fill the window.  The one that no longer fits is cut, and
its rest seeds the next window, so that every window is full; where a seed has no neighbours left, the next
unused document follows.  What remains at the end of a shard is cut into sequences whose lengths are powers of
two, which need no padding either.

A shard is the unit of work and memory; the number of shards follows the input, and a group of copies larger than
a shard is split evenly.  Texts are shuffled once.  A seed's neighbours are sought in its own shard only: those that
the splits have parted from it are not found.

Defined results: null text counts as empty and gives the closing id alone; a text of any length is cut into
windows; copies of a text are neighbours only if nothing else is left; rows that repeat are separate documents;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import partitions
from tarn.llm.dealing import deal
from tarn.llm.tokens import Encoder

WINDOW = 2048
CLOSING_ID = 1
#: Bytes of text in a shard, about.
SHARD_BYTES = 5 << 20
#: Shards that a task packs one after another, about, where there are more than the session's shuffle partitions ask for.
SHARDS_PER_TASK = 8
#: Words that more documents of a shard have than this share of them are kept as rows over all its documents.
COMMON_SHARE = 0.25
K1, B = 1.5, 0.75
#: Neighbours that are put in order at once.
FEW = 32


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        length = np.array([len(w) for w in words], np.float64)
        own = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([*[t for t, _ in own], np.zeros(0, np.uint64)])
        count = np.concatenate([*[c for _, c in own], np.zeros(0, np.int64)]).astype(np.float64)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in own])
        self.terms, inverse, df = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        self.edge = np.concatenate([[0], np.cumsum(df)])
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        norm = count + K1 * (1 - B + B * length[doc] / max(1.0, length.mean() if n else 1.0))
        self.doc, self.weight = doc[order], (idf[inverse] * count * (K1 + 1) / norm)[order].astype(np.float32)
        self.n = n
        common = np.flatnonzero(df > max(2, COMMON_SHARE * n))
        self.row = np.full(len(df), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common.tolist()):
            self.dense[k, self.doc[self.edge[t] : self.edge[t + 1]]] = self.weight[self.edge[t] : self.edge[t + 1]]
        first = np.concatenate([[0], np.cumsum([len(t) for t, _ in own])])
        self.query = [(x := inverse[first[d] : first[d + 1]])[df[x] > 1] for d in range(n)]

    def neighbours(self, d: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a word with d, by all words of d, the best first, ties by place."""
        if not len(self.query[d]):
            return
        row = self.row[self.query[d]]
        terms = self.query[d][row < 0]
        size = self.edge[terms + 1] - self.edge[terms]
        rows = np.repeat(self.edge[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[rows], weights=self.weight[rows], minlength=self.n).astype(np.float64, copy=False)
        row = row[row >= 0]
        if len(row):
            score += self.dense[row].sum(axis=0)
        found = np.flatnonzero((score > 0) & unused)
        # most windows are full after a few, so the best are ordered first and the rest only if they are asked for
        if len(found) > 2 * FEW:
            cut = -np.partition(-score[found], FEW)[FEW]
            best = found[score[found] > cut]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            found = found[score[found] <= cut]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack(sizes: np.ndarray, texts: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token of each document once."""
    n, out, sequence = len(sizes), [], 0
    unused, done, cursor, carry = np.ones(n, bool), np.zeros(n, np.int64), 0, None
    while True:
        if carry is None:
            while cursor < n and not unused[cursor]:
                cursor += 1
            if cursor == n:
                return out
            seed, unused[cursor] = cursor, False
        else:
            seed, carry = carry, None
        while sizes[seed] - done[seed] >= window:
            out.append((seed, int(done[seed]), window, sequence, 0))
            done[seed] += window
            sequence += 1
        if done[seed] == sizes[seed]:
            continue
        line, room = [], window
        waiting, now = None, seed
        same = {int(texts[seed])}
        later: list[int] = []
        while room and now is not None:
            take = int(min(room, sizes[now] - done[now]))
            line.append((now, int(done[now]), take))
            done[now] += take
            room -= take
            if done[now] < sizes[now]:
                carry = now
            if not room:
                break
            if waiting is None:
                waiting = index.neighbours(seed, unused)
            now = None
            for k in waiting:
                if int(texts[k]) in same:
                    later.append(k)
                    continue
                now = k
                break
            if now is None:
                later = [k for k in later if unused[k]]
                while cursor < n and not unused[cursor]:
                    cursor += 1
                now = cursor if cursor < n else later[0] if later else None
            if now is not None:
                unused[now] = False
                same.add(int(texts[now]))
        total = window - room
        parts = [window] if not room else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        at, left = 0, parts.pop(0)
        for d, start, length in line:
            while length:
                take = min(length, left)
                out.append((d, start, take, sequence, at))
                start, length, at, left = start + take, length - take, at + take, left - take
                if not left:
                    sequence, at = sequence + 1, 0
                    left = parts.pop(0) if parts else 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, ids_out: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids_out its ids.

    vocabulary: the path of a tokenizers file, or the name of one of the public tokenizers.
    """
    text = F.col("text").cast("string")
    # what a worker has to hold follows the texts, not their files, which copies make small; 64 bytes a row stand for the rest
    about = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("bytes")).first()
    shards = max(1, -(-int(about.bytes or 0) // SHARD_BYTES))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("tag")
    )
    rows = deal(rows, shards, F.xxhash64("doc_id", "tag"), about.n)
    tasks = max(partitions(spark), -(-shards // SHARDS_PER_TASK))
    rows = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "tag")

    def finish(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        ids, words, names, tags = [], [], [], []
        for doc_ids, doc_tags, data, at in held:
            for a in range(0, len(at) - 1):
                names.append(doc_ids[a])
                tags.append(doc_tags[a])
            flat_ids, edge = encoder.encode(data, at)
            w = flat.words(data, at, fold=True)
            for a in range(len(at) - 1):
                ids.append(np.append(flat_ids[edge[a] : edge[a + 1]], np.int32(CLOSING_ID)).astype("<u4"))
                words.append(w.hash[w.first[a] : w.first[a + 1]])
        sizes = np.array([len(x) for x in ids], np.int64)
        pieces = pack(sizes, np.array(tags, np.int64), Index(words), window)
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*part, strict=True))
            cut = [ids[i][s : s + n] for i, s, n, _, _ in part]
            columns = [
                pa.array([names[i] for i in d], pa.int64()), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(sizes[d]),
                pa.array(sequence + (shard << 32)), pa.array(offset),
            ]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids_out:
                columns, fields = [*columns, pa.array([x.astype(np.int64) for x in cut], pa.list_(pa.int64()))], [*fields, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, data, at in flat.slices(batch):
                shard = part.column(part.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
                edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                ids, tags = part.column(0).to_pylist(), part.column(2).to_pylist()
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if a == b:
                        continue
                    if now is not None and shard[a] != now:
                        yield from finish(now, held)
                        held = []
                        flat.trim()
                    now = int(shard[a])
                    held.append((ids[a:b], tags[a:b], data[at[a] : at[b]].copy(), at[a : b + 1] - at[a]))
        if held:
            yield from finish(now, held)
        flat.trim()

    return rows.mapInArrow(work, SCHEMA + ", ids array<long>" * ids_out)
