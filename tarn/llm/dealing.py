"""Dealing documents to shards by what they are about, so that related ones meet.

A bounded sample gives document frequencies of hashed words and, by subspace iteration, the main directions of its
tf-idf vectors.  Every document becomes a point in these directions.  A second sample is split again and again, at a
weighted quantile of its main direction, into REGIONS parts of equal bytes, or as many as there are shards.  A region
that stands for several shards is cut across its main direction, at quantiles that its sample gives and evenly between
them.  So shards grow in number with the input, related documents stay together, and neither the samples nor what the
driver sends out grows.  A last small coordinate comes from a hash and alone tells copies apart, so that a group larger
than a shard is split evenly.  Rows that agree in id and text too have nothing to tell them apart; those that a task
meets several times go to shards by a hash of how many it has met, so that any number of them spreads over all shards.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import Scratch

FEATURES = 1 << 13
RANK = 48
#: Documents that the directions are fitted on, at most about.
FIT_ROWS = 3000
#: Points of the second sample per shard, until there are REGIONS shards.
SHARD_POINTS = 128
REGIONS = 1024
#: Points between two quantiles of a region.
QUANTILE_POINTS = 4
#: Size of the coordinate that comes from a hash, and its weight in any direction at least.
NOISE, HASH_SHARE = 1e-3, 0.5
#: Words whose directions are gathered at a time: few enough for the cache.
CHUNK = 1 << 12


class Tree(NamedTuple):
    """Node k sends a point to left[k] if its product with direction[k] is below cut[k]; a leaf -s - 1 is region s.

    Region s is cut along across[s]: between marks[s][q] and marks[s][q + 1] lies the same share for all q.
    """

    direction: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    across: np.ndarray
    marks: list[np.ndarray]

    def region(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if len(self.cut) else np.full(len(points), -1, np.int64)
        moving = np.flatnonzero(node >= 0)
        while len(moving):
            k = node[moving]
            below = np.einsum("ij,ij->i", points[moving].astype(np.float64), self.direction[k]) < self.cut[k]
            node[moving] = np.where(below, self.left[k], self.right[k])
            moving = moving[node[moving] >= 0]
        return -node - 1

    def shard(self, points: np.ndarray, parts: int) -> np.ndarray:
        """Region by region, each cut into `parts` shards."""
        region = self.region(points)
        if parts == 1:
            return region
        place = np.einsum("ij,ij->i", points.astype(np.float64), self.across[region])
        share = np.zeros(len(points))
        for s in np.unique(region):
            own, marks = region == s, self.marks[s]
            share[own] = np.interp(place[own], marks, np.linspace(0, 1, len(marks)))
        return region * parts + np.minimum((share * parts).astype(np.int64), parts - 1)


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words, and each document's first."""
    w = flat.words(data, at, fold=True)
    return (w.hash & np.uint64(FEATURES - 1)).astype(np.int64), w.first


def directions(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """FEATURES x RANK: idf times the main directions of the unit tf-idf vectors of documents' (features, counts)."""
    n = len(counts)
    x = np.zeros((n, FEATURES), np.float32)
    for d, (feature, count) in enumerate(counts):
        x[d, feature] = count
    idf = np.log((n + 1) / ((x > 0).sum(axis=0) + 1)).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    v = np.random.default_rng(0).standard_normal((FEATURES, RANK)).astype(np.float32)
    for _ in range(6):
        v = np.linalg.qr(x.T @ (x @ v))[0]
    return (idf[:, None] * v).astype(np.float32)


def points(data: np.ndarray, at: np.ndarray, tags: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A unit vector per document, zero where nothing is known of it, and a hash of its tag as last coordinate."""
    feature, first = buckets(data, at)
    out = np.zeros((len(at) - 1, basis.shape[1] + 1), np.float32)
    for a in range(0, len(feature), CHUNK):
        b = min(a + CHUNK, len(feature))
        low, high = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
        edge = np.clip(first[low : high + 1], a, b)
        filled = np.flatnonzero(np.diff(edge))
        out[low + filled, :-1] += np.add.reduceat(basis[feature[a:b]], edge[filled] - a, axis=0)
    out[:, :-1] /= np.maximum(np.linalg.norm(out[:, :-1], axis=1, keepdims=True), 1e-9)
    out[:, -1] = NOISE * (flat.mix64(tags.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return out


def main_direction(x: np.ndarray) -> np.ndarray | None:
    """The vector along which the points lie farthest apart, with some of the hash, so that a cut parts copies too; None where they are one point."""
    if not len(x):
        return None
    middle = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - middle).T @ (x - middle))
    if values[-1] <= 1e-12 * len(x):
        return None
    best = vectors[:, -1] * (1 if vectors[np.argmax(np.abs(vectors[:, -1])), -1] > 0 else -1)
    best[-1] = max(abs(best[-1]), HASH_SHARE)
    return best


def tree(sample: np.ndarray, weight: np.ndarray, regions: int) -> Tree:
    """Splits of the sample into regions of about equal weight, and their quantiles."""
    direction, cut, left, right, region = [], [], [], [], 0
    hashed = np.eye(sample.shape[1])[-1]
    across, marks = [], []
    todo = [(np.arange(len(sample)), regions, None, None)]
    while todo:
        rows, parts, parent, side = todo.pop()
        x = sample[rows].astype(np.float64)
        best = main_direction(x)
        if parts == 1:
            at = -region - 1
            region += 1
            across.append(hashed if best is None else best)
            if best is None:  # a single point or none: the hash decides
                marks.append(np.array([0.0, NOISE]))
            else:
                line = np.sort(x @ best)
                marks.append(np.quantile(line, np.linspace(0, 1, max(2, len(line) // QUANTILE_POINTS + 1))))
        else:
            at = len(cut)
            if best is not None:
                place = x @ best
                order = np.argsort(place, kind="stable")
                half = np.searchsorted(np.cumsum(weight[rows][order]), weight[rows].sum() * (parts // 2) / parts)
                half = min(max(1, int(half)), len(rows) - 1)
                middle_cut = (place[order[half - 1]] + place[order[half]]) / 2
            else:
                best, order, half = hashed, np.arange(len(rows)), 0
                middle_cut = NOISE * (parts // 2) / parts
            direction.append(best)
            cut.append(middle_cut)
            left.append(0)
            right.append(0)
            todo.append((rows[order[half:]], parts - parts // 2, at, right))
            todo.append((rows[order[:half]], parts // 2, at, left))
        if side is not None:
            side[parent] = at
    empty = np.zeros((0, sample.shape[1]))
    return Tree(np.array(direction) if direction else empty, np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(across), marks)


def fit(rows: DataFrame, regions: int, tag: Column, n: int) -> tuple[np.ndarray, Tree]:
    """Directions and tree for n rows(doc_id, text, tag); `tag` is a number that differs between rows, its hash samples."""
    n = max(1, n)
    scratch = Scratch(rows.sparkSession, "dealing")
    pick = F.pmod(F.xxhash64(F.lit("sample"), F.col("k")), F.lit(1 << 40))

    def share(wanted: int) -> Column:
        return F.lit(True) if wanted >= n else pick < int(wanted / n * (1 << 40))

    # rows that agree in everything are one row of the sample, however many there are
    few = rows.select("text", tag.alias("k")).filter(share(max(FIT_ROWS, SHARD_POINTS * regions))).groupBy("k").agg(F.first("text").alias("text"))
    few = scratch.keep(few, "sample")

    def sample(wanted: int) -> DataFrame:
        return few.filter(share(wanted))

    def count(batches):
        for batch in batches:
            for part, data, at in flat.slices(batch):
                feature, first = buckets(data, at)
                own = [np.unique(feature[a:b].astype(np.int32), return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("k")), *columns], names=["k", "feature", "count"])

    # only the hash decides, so that the sample is the same on any partitioning
    first = sample(FIT_ROWS).select("text", "k").mapInArrow(count, "k long, feature binary, count binary").orderBy("k").limit(FIT_ROWS + 500).collect()
    basis = directions([(np.frombuffer(bytes(r.feature), np.int32), np.frombuffer(bytes(r["count"]), np.int32)) for r in first])

    def project(batches):
        for batch in batches:
            for part, data, at in flat.slices(batch):
                tags = part.column(part.schema.get_field_index("k")).to_numpy(zero_copy_only=False).astype(np.int64)
                p = points(data, at, tags, basis)
                yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(np.diff(at) + 64), pa.array([x.tobytes() for x in p], pa.binary())], names=["k", "size", "point"])

    second = sample(SHARD_POINTS * regions).select("text", "k").mapInArrow(project, "k long, size long, point binary").collect()
    second.sort(key=lambda r: (r.k, r.size))
    spots = np.frombuffer(b"".join(bytes(r.point) for r in second), np.float32).reshape(-1, basis.shape[1] + 1)
    scratch.drop("sample")
    return basis, tree(spots, np.array([r.size for r in second], np.float64), regions)


class Repeats:
    """Rows of a task whose tag it has met before, or meets again in the same slice, with a hash for each."""

    def __init__(self, task: int):
        self.task, self.met = np.uint64(task), {}

    def find(self, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows repeat, and hashes that differ between all of one tag and between tasks."""
        names, inverse, count = np.unique(tags, return_inverse=True, return_counts=True)
        before = np.array([self.met.get(t, 0) for t in names.tolist()], np.int64)
        self.met.update(zip(names.tolist(), (before + count).tolist(), strict=True))
        order = np.argsort(inverse, kind="stable")
        turn = np.empty(len(tags), np.int64)
        turn[order] = np.arange(len(tags)) - np.repeat(np.cumsum(count) - count, count)
        turn += before[inverse]
        salt = flat.mix64(turn.view(np.uint64) + (self.task << np.uint64(40)))
        return ((before > 0) | (count > 1))[inverse], flat.mix64(tags.view(np.uint64) + salt)


def deal(rows: DataFrame, shards: int, tag: Column, n: int | None = None) -> DataFrame:
    """rows, n of them, with a column shard, below `shards` or the next multiple of REGIONS above it."""
    if shards == 1:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    regions = min(shards, REGIONS)
    parts = -(-shards // regions)
    basis, splits = fit(rows, regions, tag, rows.count() if n is None else n)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((basis, splits))  # at most REGIONS directions and quantiles

    def place(batches):
        basis_, splits_ = shared.value
        repeats = Repeats(TaskContext.get().partitionId())
        for batch in batches:
            for part, data, at in flat.slices(batch):
                tags = part.column(part.schema.get_field_index("k")).to_numpy(zero_copy_only=False).astype(np.int64)
                shard = splits_.shard(points(data, at, tags, basis_), parts)
                again, hashed = repeats.find(tags)
                shard[again] = (hashed[again] % np.uint64(regions * parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shard, pa.int64())], names=[*part.schema.names[:-1], "shard"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", shard bigint"
    return rows.withColumn("k", tag).mapInArrow(place, schema)
