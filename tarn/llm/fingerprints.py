"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A document is the bag of its words, each with its count as weight.  Every coordinate draws, from the word's
hash alone, two gamma and one uniform variable per word, and samples one (word, step) pair; two documents
agree in a coordinate with the generalised Jaccard similarity of their bags, sum of minima over sum of
maxima.  A fingerprint is 128 coordinates of 16 bits, as hexadecimal digits.

Next documents meet without a global sort in one task: rows are dealt into ranges of ids, and the first rows
of each range go to the range before it as well.  A range begins at an id that occurs, so its first rows are
known by their id.  Rows without an id follow in the order of their text's hash, in ranges of that.  The ranges
come from a sample of ids, which grows with the input by a row for some MB.  Texts are shuffled once.

Defined results: null or blank text has the empty bag, whose fingerprint is all zeros and is like another
empty one (1) and unlike any other (0); null ids come last; rows that repeat an id follow each other in the
order of their text's hash; a single row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import input_bytes, partitions

COORDINATES = 128
#: Bytes of input that a range of ids stands for, and how many sampled ids it takes to place its start.
RANGE_BYTES, RANGE_SAMPLE = 64 << 20, 16
#: Terms sampled at a time: few enough for the cache, and always so many, so that any machine rounds alike.
_TERMS_AT_ONCE = 128
_SEEDS = flat.keyed(COORDINATES, 5)


def _samples(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For weighted terms (rows) and coordinates (columns): the sampling key, least wins, and 16 bits that name the sample."""
    a = flat.mix64(term[:, None] ^ _SEEDS[None, :])
    b = (a ^ (a >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    b ^= b >> np.uint64(32)
    unit, half, mask = np.float32(2.0**-24), np.float32(0.5), np.uint64(0xFFFFFF)

    def uniform(bits: np.ndarray, shift: int) -> np.ndarray:
        return (((bits >> np.uint64(shift)) & mask).astype(np.uint32).astype(np.float32) + half) * unit

    r = -np.log(uniform(a, 40) * uniform(a, 16))
    ln_c = np.log(-np.log(uniform(b, 40) * uniform(b, 16)))
    beta = ((a & np.uint64(0xFFFF)).astype(np.uint32).astype(np.float32) + half) * np.float32(2.0**-16)
    step = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
    key = ln_c - r * (step - beta + np.float32(1))
    name = ((b ^ (step.astype(np.int64).view(np.uint64) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return key, name.astype(np.uint16)


def bags(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct words' hashes, ascending, and their counts, for each document."""
    w = flat.words(data, at)
    return [np.unique(w.hash[a:b], return_counts=True) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def sketches(bag: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 16-bit coordinates per bag, and whether it has a word."""
    out, some = np.zeros((len(bag), COORDINATES), np.uint16), np.array([len(t) > 0 for t, _ in bag], bool)
    edge = np.concatenate([[0], np.cumsum([len(t) for t, _ in bag], dtype=np.int64)])
    if not edge[-1]:
        return out, some
    terms, weights = np.concatenate([t for t, _ in bag]), np.concatenate([c for _, c in bag])
    _, place, where = np.unique(flat.mix64(terms + weights.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    size = -len(place) % _TERMS_AT_ONCE
    place = np.concatenate([place, np.zeros(size, np.int64)])
    key, name = np.empty((len(place), COORDINATES), np.float32), np.empty((len(place), COORDINATES), np.uint16)
    for a in range(0, len(place), _TERMS_AT_ONCE):
        rows = place[a : a + _TERMS_AT_ONCE]
        key[a : a + _TERMS_AT_ONCE], name[a : a + _TERMS_AT_ONCE] = _samples(terms[rows], weights[rows])
    columns = np.arange(COORDINATES)
    for d in np.flatnonzero(some):
        mine = where[edge[d] : edge[d + 1]]
        least, chosen = None, None
        for a in range(0, len(mine), 4096):
            part = mine[a : a + 4096]
            keys = key[part]
            best = np.argmin(keys, axis=0)
            value, names = keys[best, columns], name[part[best], columns]
            if least is None:
                least, chosen = value, names
            else:
                chosen = np.where(value < least, names, chosen)
                least = np.minimum(value, least)
        out[d] = chosen
    return out, some


def likeness(a: np.ndarray, some_a, b: np.ndarray, some_b) -> np.ndarray:
    """Share of equal coordinates; 1 for two empty bags, 0 for one."""
    return np.where(some_a & some_b, (a == b).mean(axis=-1), (some_a == some_b).astype(float))


class Ranges:
    """Ranges of (id) and, beyond the last id, of (hash of a text without one): each begins at a key that occurs."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids, self.hashes = np.unique(ids), np.unique(hashes)

    def part(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and for a range's first rows the range before it, around the end; -1 for others."""
        total = len(self.ids) + len(self.hashes)
        part = np.where(null, len(self.ids) + np.searchsorted(self.hashes, hashes, "right"), np.searchsorted(self.ids, ids, "right")) - 1
        starts = np.concatenate([self.ids, self.hashes])[part]
        first = starts == np.where(null, hashes, ids)
        return part.astype(np.int64), np.where(first, (part - 1) % total, -1)


def _ranges(spark: SparkSession, docs: DataFrame) -> Ranges | None:
    ids = docs.select(F.col("doc_id").cast("long").alias("key"))
    about = ids.agg(F.count("*").alias("n"), F.count("key").alias("named"), F.min("key").alias("least")).first()
    if not about.n:
        return None
    wanted = max(4 * partitions(spark), input_bytes(docs) // RANGE_BYTES)

    share = min(1.0, wanted * RANGE_SAMPLE / about.n)

    def starts(keys: DataFrame, least: int) -> np.ndarray:
        low = keys.filter(F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
        found = np.sort(low.toPandas()["key"].to_numpy(np.int64))
        return np.append(found[::RANGE_SAMPLE], np.int64(least))

    nameless = np.zeros(0, np.int64)
    if about.named < about.n:
        tags = docs.filter(F.col("doc_id").cast("long").isNull()).select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
        nameless = starts(tags, tags.agg(F.min("key")).first()[0])
    return Ranges(starts(ids.filter("key is not null"), about.least) if about.named else np.zeros(0, np.int64), nameless)


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ranges = _ranges(spark, docs)
    if ranges is None:
        schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], schema)
    total = len(ranges.ids) + len(ranges.hashes)
    shared = spark.sparkContext.broadcast(ranges)  # a number per range

    @F.pandas_udf("part long, before long")
    def place(ids: pd.Series, null: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        part, before = shared.value.part(ids.to_numpy(np.int64), null.to_numpy(bool), hashes.to_numpy(np.int64))
        return pd.DataFrame({"part": part, "before": before})

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))
    keys = keys.withColumn("at", place(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tag"))
    own = F.struct(F.col("at.part").alias("part"), F.lit(0).alias("border"))
    other = F.struct(F.col("at.before").alias("part"), F.lit(1).alias("border"))
    rows = keys.withColumn("to", F.explode(F.when(F.col("at.before") < 0, F.array(own)).otherwise(F.array(own, other))))
    rows = rows.select("to.part", "to.border", "doc_id", "text", "tag")
    tasks = max(partitions(spark), total // 4)
    rows = rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "border", F.col("doc_id").asc_nulls_last(), "tag")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the row that waits for its next: part, border, id, text, sketch, some
        for batch in batches:
            for piece, data, at in flat.slices(batch, limit=flat.SLICE_BYTES // 2):
                now = [[*x, None, None] for x in zip(*(piece.column(k).to_pylist() for k in range(4)), strict=True)]
                line = ([held] if held else []) + now
                pairs = [(k, k + 1) for k in range(len(line) - 1) if line[k][0] == line[k + 1][0] and not line[k][1]]
                edited = [line[k][3][: len(line[k][3]) - len(line[k][3]) // 2] + line[n][3][: len(line[k][3]) // 2] for k, n in pairs]
                sketch, some = sketches(bags(data, at) + bags(*flat.buffers(pa.array(edited, pa.large_string()))))
                for k, x in enumerate(now):
                    x[4], x[5] = sketch[k], some[k]
                other, other_some = sketch[len(now) :], some[len(now) :]
                held = line[-1]
                if not pairs:
                    continue
                pairs = [(line[k], line[n]) for k, n in pairs]
                own, own_some = np.stack([x[4] for x, _ in pairs]), np.array([x[5] for x, _ in pairs])
                nxt, nxt_some = np.stack([y[4] for _, y in pairs]), np.array([y[5] for _, y in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array([s.astype(">u2").tobytes().hex() for s in own], pa.string()),
                        pa.array([s.astype(">u2").tobytes().hex() for s in other], pa.string()),
                        pa.array(likeness(own, own_some, other, other_some)),
                        pa.array(likeness(own, own_some, nxt, nxt_some)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
