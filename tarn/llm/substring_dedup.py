"""Removal of long passages that repeat, found through difference-cover anchors.

A window is `window` consecutive words.  With a period v and a difference cover D of the residues modulo v,
any two places i and j have a shift s < v with (i + s) mod v and (j + s) mod v both in D.  So if two windows
agree, they share an anchor: a run of window - v + 1 words at a place of D, the same distance into both.
First only anchors are hashed (5 of 21 places) and matched over the corpus.  Then matches are extended:
only windows that hold a matched anchor are hashed in full and matched again, which decides exactly.

Matching never forms pairs.  Hashes go to hash-range buckets as packed arrays, one row per chunk of documents
and bucket; a bucket says for each entry whether it occurs again.  Inside a chunk a hash is sent once, so a
passage that a third of all rows share costs its bucket one entry per chunk.  The number of buckets follows
the input.  Texts are shuffled twice, to meet the answers of either round.

Defined results: null text has no words; a text shorter than a window keeps all; rows that repeat doc_id and
text repeat each other's windows like any two documents; a null doc_id is an id like others; an empty table
gives an empty result.  Hashes have 63 bits.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import input_bytes, partitions

WINDOW = 35
PERIOD = 21
#: Hashes that a chunk gathers before it is sent.
CHUNK_ITEMS = 600_000
#: Input bytes that a bucket stands for.
BUCKET_BYTES = 4 << 20
ROWS = "chunk long, bucket long, data binary"


def difference_cover(period: int) -> np.ndarray:
    """A small set of residues whose differences are all residues, as a mask; the first that a search by size finds."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                mask = np.zeros(period, bool)
                mask[list(chosen)] = True
                return mask
    raise ValueError(period)


class Chunk:
    """Items of many documents on their way to the buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.number = buckets, 0
        self.docs: list = []
        self.parts: list[np.ndarray] = []
        self.items = 0

    def add(self, ids: list, tags: list, counts: np.ndarray, hashes: np.ndarray, extra: list) -> None:
        self.docs.append((ids, tags, counts, extra))
        self.parts.append(hashes)
        self.items += len(hashes)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.items:
            self.docs, self.parts = [], []
            return
        task = TaskContext.get()
        chunk = ((task.partitionId() if task else 0) << 32) + self.number
        h = np.concatenate(self.parts)
        _, index, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        local, sent = count[inverse] > 1, np.zeros(len(h), bool)
        sent[index] = True
        hs = h[sent]
        bucket = (hs % np.uint64(self.buckets)).astype(np.uint32)
        value = (hs & ~np.uint64(1)) | local[sent].astype(np.uint64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        names = bucket[order][edge[:-1]].astype(np.int64)
        packed = value[order]
        data = [packed[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        narrow = bucket.astype(np.uint8 if self.buckets <= 256 else np.uint16 if self.buckets <= 65536 else np.uint32)
        side = pickle.dumps((self.docs, len(h), np.packbits(local), np.packbits(sent), narrow), protocol=5)
        self.docs, self.parts, self.items, self.number = [], [], 0, self.number + 1
        for a in range(0, len(data), 256):
            part = data[a : a + 256]
            yield _rows([chunk] * len(part), names[a : a + 256], part)
        yield _rows([chunk], [-1 - chunk % self.buckets], [side])


def _rows(chunk, bucket, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"]
    )


def _answer(bucket: int, chunks: list[int], arrays: list[bytes]) -> Iterator[pa.RecordBatch]:
    """For each packed array of the bucket: a bit per entry that says whether it occurs again."""
    values = [np.frombuffer(x, np.uint64) for x in arrays]
    every = np.concatenate(values)
    _, inverse, count = np.unique(every & ~np.uint64(1), return_inverse=True, return_counts=True)
    again = count > 1
    again[inverse[(every & np.uint64(1)) == 1]] = True
    bits, at, out = again[inverse], 0, ([], [])
    for chunk, v in zip(chunks, values, strict=True):
        part = bits[at : at + len(v)]
        at += len(v)
        if part.any():
            out[0].append(chunk)
            out[1].append(np.packbits(part).tobytes())
    if out[0]:
        yield _rows(out[0], [bucket] * len(out[0]), out[1])


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket."""
    now, chunks, arrays = None, [], []
    for batch in batches:
        for chunk, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket < 0:
                yield _rows([chunk], [bucket], [data])
                continue
            if bucket != now and chunks:
                yield from _answer(now, chunks, arrays)
                chunks, arrays = [], []
            now = bucket
            chunks.append(chunk)
            arrays.append(data)
    if chunks:
        yield from _answer(now, chunks, arrays)


MASKS = "m_id long, m_tag long, extra binary, bits binary"


def _masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by chunk, its description first: one row per document that has a repeated item."""

    def emit() -> Iterator[pa.RecordBatch]:
        ids, tags, more, bits, at = [], [], [], [], 0
        for doc_ids, doc_tags, counts, extra in docs:
            for i, tag, n, x in zip(doc_ids, doc_tags, counts.tolist(), extra or itertools.repeat(b""), strict=False):
                part = found[at : at + n]
                at += n
                if n and part.any():
                    ids.append(i)
                    tags.append(tag)
                    more.append(x)
                    bits.append(np.packbits(part).tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(more, pa.binary()), pa.array(bits, pa.binary())],
                names=["m_id", "m_tag", "extra", "bits"],
            )

    docs, found, place, order, names = None, None, None, None, None
    for batch in batches:
        for _, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket < 0:
                if docs is not None:
                    yield from emit()
                docs, n, local, sent, names = pickle.loads(data)
                found = np.unpackbits(local, count=n).astype(bool)
                place = np.flatnonzero(np.unpackbits(sent, count=n))
                order = np.argsort(names, kind="stable")
                names = names[order]
            else:
                a, b = np.searchsorted(names, [bucket, bucket + 1])
                mine = place[order[a:b]]
                found[mine[np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)]] = True
    if docs is not None:
        yield from emit()


def _match(items: DataFrame, parts: int) -> DataFrame:
    """Rows of packed items to one mask per document with repeated items."""
    answers = items.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answers, ROWS)
    masks = answers.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_masks, MASKS)
    return masks.groupBy("m_id", "m_tag").agg(F.first("extra").alias("extra"), F.first("bits").alias("bits"))


def _local(first: np.ndarray) -> np.ndarray:
    """Each word's place in its own document."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, period: int = PERIOD, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, and with text_out the kept words as `text`."""
    if not 1 <= period <= window:
        raise ValueError("the period lies between 1 and the window")
    cover, anchor = difference_cover(period), window - period + 1
    parts = partitions(spark)
    buckets = max(2 * parts, input_bytes(docs) // BUCKET_BYTES)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))

    def places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors among a slice's words, and how many each document has."""
        local, left = _local(first), np.repeat(first[1:], np.diff(first))
        at = np.flatnonzero(cover[local % period] & (np.arange(first[-1]) + anchor <= left))
        return at, np.diff(np.searchsorted(at, first))

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(buckets)
        for batch in batches:
            for part, data, at in flat.slices(batch):
                w = flat.words(data, at)
                hashes, place = flat.windows(w.hash, w.first, anchor)
                where, counts = places(w.first)
                chunk.add(part.column(0).to_pylist(), part.column(1).to_pylist(), counts, hashes[np.searchsorted(place, where)], [])
                if chunk.items >= CHUNK_ITEMS:
                    yield from chunk.rows()
        yield from chunk.rows()

    def extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(buckets)
        for batch in batches:
            bits_at = batch.schema.get_field_index("bits")
            for part, data, at in flat.slices(batch):
                w = flat.words(data, at)
                where, counts = places(w.first)
                hit = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part.column(bits_at).to_pylist(), counts.tolist(), strict=True)] or [np.zeros(0, np.uint8)])
                where = where[hit.astype(bool)]
                # windows that start less than a period before a matched anchor, in the same document
                step = np.zeros(w.first[-1] + 1, np.int64)
                doc_first = w.first[np.searchsorted(w.first, where, "right") - 1]
                np.add.at(step, np.maximum(where - period + 1, doc_first), 1)
                np.add.at(step, where + 1, -1)
                hashes, place = flat.windows(w.hash, w.first, window)
                near = np.cumsum(step[:-1]) > 0
                mine = near[place]
                place = place[mine]
                counts = np.diff(np.searchsorted(place, w.first))
                chosen = np.zeros(w.first[-1], bool)
                chosen[place] = True
                extra = [np.packbits(chosen[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                chunk.add(part.column(0).to_pylist(), part.column(1).to_pylist(), counts, hashes[mine], extra)
                if chunk.items >= CHUNK_ITEMS:
                    yield from chunk.rows()
        yield from chunk.rows()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra_at, bits_at = (batch.schema.get_field_index(x) for x in ("extra", "bits"))
            for part, data, at in flat.slices(batch):
                start, end, first = flat.spans(data, at)
                n_words, removed, digest, texts = np.diff(first), [], [], []
                for d, (extra, bits) in enumerate(zip(part.column(extra_at).to_pylist(), part.column(bits_at).to_pylist(), strict=True)):
                    s, e, n = start[first[d] : first[d + 1]], end[first[d] : first[d + 1]], int(n_words[d])
                    gone = 0
                    if bits is not None:
                        place = np.flatnonzero(np.unpackbits(np.frombuffer(extra, np.uint8), count=n))
                        place = place[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(place)).astype(bool)]
                        step = np.zeros(n + 1, np.int64)
                        step[place] += 1
                        step[place + window] -= 1
                        stay = np.cumsum(step[:-1]) == 0
                        s, e = s[stay], e[stay]
                        gone = n - len(s)
                    out = b""
                    if len(s):
                        low = int(s[0])
                        raw = np.append(data[low : int(e[-1])], np.uint8(32))
                        raw[flat.SPACE[raw]] = 32
                        edge = np.zeros(len(raw) + 1, np.int8)
                        edge[s - low] += 1
                        edge[e - low + 1] -= 1
                        out = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()[:-1]
                    removed.append(gone)
                    digest.append(hashlib.sha256(out).hexdigest())
                    if text_out:
                        texts.append(out.decode())
                columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if text_out:
                    columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def meet(masks: DataFrame, how: str) -> DataFrame:
        on = rows["doc_id"].eqNullSafe(masks["m_id"]) & (rows["tag"] == masks["m_tag"])
        return rows.join(masks.hint("merge"), on, how).select("doc_id", "tag", "text", "extra", "bits")

    first = _match(rows.mapInArrow(anchors, ROWS), parts)
    second = _match(meet(first, "inner").mapInArrow(extended, ROWS), parts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text_out
    return meet(second, "left").mapInArrow(cut, schema)
