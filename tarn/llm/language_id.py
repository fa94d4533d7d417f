"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (1 to 3 bytes; A-Z folded, other ASCII that is no letter
counts as one space), weighted by tf-idf and of length one.  The training vectors of a language are grouped
by spherical k-means into a few centroids; a text gets the language of the centroid with the highest cosine.
A text that is farther from its language's centroids than nearly all texts of that language are is marked as
rejected; how far that is comes from texts that the centroids were not fitted on, in FOLDS turns.

Fitting reads a bounded sample: at most SAMPLE_ROWS labelled rows, the same number per language at most,
those first in seeded hash order.  A threshold on the hash, from counts per language, cuts the rows to about
twice that before anything is ordered.  Prediction reads every text whole, in one pass without a shuffle.

Defined results: `und` with score 0 for a text that is null or has no letter, and for all texts if nothing
was learned; ties go to the alphabetically first language; a null doc_id is never trained on and not held
out; rows that repeat are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import column_or_null

DIMENSIONS = 4096
SAMPLE_ROWS = 2400
ROWS_PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
#: Share of a language's texts that may lie beyond its rejection distance.
REJECTED_SHARE = 0.005
FOLDS = 4

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray  # of each centroid
    least: np.ndarray  # cosine below which each centroid rejects, the same for those of a language


def ngram_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of DIMENSIONS n-gram counts for each document."""
    n = len(at) - 1
    out = np.zeros(n * DIMENSIONS, np.float32)
    if not len(data):
        return out.reshape(n, DIMENSIONS)
    chars = _MAP[data]
    code = chars.astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(at))
    space = chars == 0x20
    ok = ~space
    for size in (1, 2, 3):
        if size > 1:
            code = (code[:-1] << np.uint32(8)) | chars[size - 1 :]
            # within one document, with no two spaces side by side
            ok = (row[: len(code)] == row[size - 1 :]) & ~(space[size - 2 : -1] & space[size - 1 :])
            if size == 3:
                ok &= ~(space[:-2] & space[1:-1])
        mixed = ((code + np.uint32(size * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount((row[: len(code)] + mixed)[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length, the first seed the most central row, each next the farthest from those before."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(int(np.argmin(near)))
    c = x[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def weights(counts: np.ndarray) -> np.ndarray:
    """Inverse document frequencies of the n-grams."""
    return (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)


def rejection(counts: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """For each language the cosine that all but REJECTED_SHARE of its texts reach with a model fitted on other texts."""
    fold, near = np.arange(len(labels)) % FOLDS, np.full(len(labels), np.nan)
    for k in range(FOLDS):
        rest = fold != k
        if not rest.any():
            continue
        idf = weights(counts[rest])
        for lang in set(labels[rest]):
            own = (fold == k) & (labels == lang)
            if own.any():
                c, _ = spherical_kmeans(vectors(counts[rest & (labels == lang)], idf), CENTROIDS)
                near[own] = (vectors(counts[own], idf) @ c.T).max(axis=1)
    out = {}
    for lang in set(labels):
        seen = near[(labels == lang) & ~np.isnan(near)]
        out[lang] = float(np.quantile(seen, REJECTED_SHARE)) if len(seen) else 0.0
    return out


def fit(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from text and lang of rows that are not held out."""
    doc_id, lang = F.col("doc_id").cast("long"), column_or_null(docs, "lang", "string")
    usable = docs.select(doc_id.alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    # ids and languages alone, no texts: how many rows a language has says which hashes are low enough
    have = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return None
    each = max(1, min(ROWS_PER_LANGUAGE, sample_rows // len(have)))
    below = spark.createDataFrame([(k, min(1.0, (2 * each + 50) / n)) for k, n in have.items()], "lang string, share double")
    hashed = F.xxhash64(F.lit(7), "doc_id")
    low = usable.select("doc_id", "lang").join(F.broadcast(below), "lang").filter(F.pmod(hashed, F.lit(1 << 40)) < F.col("share") * (1 << 40))  # below: a row per language
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    chosen = low.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).drop("k")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                rows = [x.tobytes() for x in ngram_counts(data, at)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "lang", "counts"])

    picked = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).filter("text is not null").select("doc_id", "lang", "text")  # chosen: the sample's ids
    picked = picked.mapInArrow(count, "doc_id long, lang string, counts binary").groupBy("doc_id", "lang").agg(F.min("counts").alias("counts"))
    rows = sorted((r.lang, r.doc_id, bytes(r.counts)) for r in picked.collect())
    if not rows:
        return None
    labels = np.array([r[0] for r in rows], object)
    counts = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), DIMENSIONS)
    idf, far = weights(counts), rejection(counts, labels)
    x = vectors(counts, idf)
    centroids, language = [], []
    for lang in sorted(set(labels)):
        c, _ = spherical_kmeans(x[labels == lang], CENTROIDS)
        centroids.extend(c)
        language.extend([lang] * len(c))
    return Model(idf, np.stack(centroids).astype(np.float32), np.array(language, object), np.array([far[k] for k in language]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and rejected, by texts alone."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                n = part.num_rows
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
                has = letters[at[1:]] > letters[at[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = _LETTER.search(data[at[i] : at[i + 1]].tobytes().decode()) is not None
                lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
                if model is not None and n:
                    near = vectors(ngram_counts(data, at), model.idf) @ model.centroids.T
                    best = np.argmax(near, axis=1)
                    lang[has] = model.language[best][has]
                    score[has] = np.clip(near[np.arange(n), best], 0, 1)[has]
                    rejected[has] = (score < model.least[best])[has]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
