"""Quality classifier from weak labels.

Heuristic labellers look at a text and say junk, clean or nothing.  They overlap and err, and nobody says
which is right: expectation-maximisation over the counts of vote patterns estimates how each labeller votes
on junk and on clean texts, and with that each pattern's posterior.  The posteriors are the labels on which
a linear scorer over hashed features (runs of character classes, repeated words) is trained; it decides.

Pattern counts cover all rows; there are at most 3 to the number of labellers of them.  The scorer is
fitted on a bounded sample, SAMPLE_ROWS rows in seeded hash order, with rows of either kind, and on the
driver.  Two passes over the texts, neither with a shuffle of texts.

Defined results: null, empty or blank text has score 0 and is rejected; a null doc_id is scored like any; if
the table has no text with words, nothing is learned and all is rejected; rows that repeat are judged alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tarn.llm import flat
from tarn.llm.common import Scratch, named, unused

ABSTAIN, CLEAN, JUNK = 0, 1, 2
DIMENSIONS = 2048
SAMPLE_ROWS = 4000
#: A labeller's share of junk votes among its votes on clean texts, at most.
FALSE_ALARMS = 0.05
#: Rows' worth of weight from which a kind counts as much as the other in training.
LEAST_ROWS = 5.0
#: A text is rejected when the scorer's probability of junk exceeds this.
REJECT_ABOVE = 0.6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
#: Character classes: letters and bytes beyond ASCII 0, capitals 1, digits 2, spaces 3, line ends 4, stops 5, others by their kind.
_CLASS = np.full(256, 9, np.uint16)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[_SYMBOL & (np.arange(256) != ord("|"))] = 8


def statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: the shares that the labellers look at."""
    w = flat.words(data, at, fold=True)
    n_words = np.diff(w.first)
    words = np.maximum(n_words, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])[at])

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[w.first])

    upper, lower = total(_UPPER), total(_LOWER)
    alnum = np.concatenate([[0], np.cumsum(flat.ALNUM[data], dtype=np.int64)])
    bare = alnum[w.end] == alnum[w.start]
    again = np.zeros(len(w.hash), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    inner = w.first[:-1][w.first[:-1] < len(again)]
    again[inner] = False
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], np.int64)
    return {
        "words": n_words,
        "symbols": total(_SYMBOL) / words,
        "shouts": total(_SHOUT) / words,
        "upper": upper / np.maximum(upper + lower, 1),
        "bare": of_words(bare) / words,
        "again": of_words(again) / words,
        "distinct": distinct / words,
        "short": of_words((w.end - w.start <= 3) & ~bare) / words,
        "stops": of_words((last == ord(".")) | (last == ord(","))) / words,
        "ascii": (upper + lower) / np.maximum(np.diff(at), 1),
    }


#: Labellers: what they look at, junk beyond the first bound, clean within the second, texts they speak about.
LABELLERS = (
    ("symbols", lambda s: s["symbols"] > 0.35, lambda s: s["symbols"] < 0.05),
    ("shouts", lambda s: s["shouts"] > 0.3, lambda s: s["shouts"] < 0.03),
    ("capitals", lambda s: (s["upper"] > 0.5) & (s["words"] >= 5), lambda s: s["upper"] < 0.15),
    ("bare marks", lambda s: s["bare"] > 0.15, lambda s: s["bare"] < 0.02),
    ("repeated words", lambda s: s["again"] > 0.15, lambda s: (s["again"] < 0.03) & (s["words"] >= 5)),
    ("few different words", lambda s: (s["distinct"] < 0.25) & (s["words"] >= 30), lambda s: (s["distinct"] > 0.35) & (s["words"] >= 30)),
    ("no short words", lambda s: (s["short"] < 0.06) & (s["words"] >= 30) & (s["ascii"] > 0.5), lambda s: (s["short"] > 0.15) & (s["words"] >= 10)),
    ("stops", lambda s: (s["stops"] > 0.6) & (s["words"] >= 10), lambda s: (s["stops"] > 0.02) & (s["stops"] < 0.35) & (s["words"] >= 10)),
)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A column of votes per labeller."""
    return np.stack([np.where(junk(stats), JUNK, np.where(clean(stats), CLEAN, ABSTAIN)) for _, junk, clean in LABELLERS], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpattern(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class Weak(NamedTuple):
    prior: float  # of junk
    table: np.ndarray  # labeller, kind (clean, junk), vote; no vote says nothing, so its column is 1


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> Weak:
    """How labellers vote on clean and junk texts, from vote patterns and how often each occurs.

    A labeller is taken to be better than chance: at most FALSE_ALARMS of its votes on clean texts say junk, and
    as many more of those on junk.  Without that, and with most texts junk, the two kinds would settle on two
    sorts of junk.  The share of junk is free.
    """
    table = np.tile(np.array([[1, 0.97, 0.03], [1, 0.6, 0.4]]), (v.shape[1], 1, 1))
    prior, onehot = 0.5, np.stack([v == k for k in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        junk = posterior(Weak(prior, table), v)
        new = []
        for weight, low, high in ((n * (1 - junk), 0.0, FALSE_ALARMS), (n * junk, 2 * FALSE_ALARMS, 1.0)):
            counts = np.einsum("p,plk->lk", weight, onehot)[:, 1:] + 0.5
            says = np.clip(counts[:, 1] / counts.sum(axis=1), max(low, 1e-4), min(high, 1 - 1e-4))
            new.append(np.stack([np.ones(len(says)), 1 - says, says], axis=1))
        table, prior = np.stack(new, axis=1), float(np.clip((n * junk).sum() / n.sum(), 1e-4, 1 - 1e-4))
    return Weak(prior, table)


def posterior(weak: Weak, v: np.ndarray) -> np.ndarray:
    """Probability of junk."""
    lab = np.arange(v.shape[1])
    logs = np.log(weak.table)
    clean = np.log(1 - weak.prior) + logs[lab, 0, v].sum(axis=1)
    junk = np.log(weak.prior) + logs[lab, 1, v].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(clean - junk, -500, 500)))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed features, a row of length one per document."""
    n = len(at) - 1
    kind = _CLASS[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(at))
    out = np.zeros(n * DIMENSIONS)
    for size in (2, 4):
        if len(kind) < size:
            continue
        code = np.zeros(len(kind) - size + 1, np.uint32)
        for j in range(size):
            code = code * np.uint32(11) + kind[j : len(kind) - size + 1 + j]
        ok = row[: len(code)] == row[size - 1 :]
        slot = ((code + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(21)
        out += np.bincount((row[: len(code)] + slot)[ok], minlength=len(out))
    w = flat.words(data, at, fold=True)
    if len(w.hash) > 1:
        doc = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(w.first))
        same = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        # a repeated word weighs as much as its characters
        size = (w.end - w.start)[1:]
        out += np.bincount(doc[1:] + np.where(same, 17, 18), weights=size, minlength=len(out))
    x = np.sqrt(out.reshape(n, DIMENSIONS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, step: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with momentum; each kind weighs the same, unless there is next to nothing of it."""
    weight = y / max(y.sum(), LEAST_ROWS) + (1 - y) / max((1 - y).sum(), LEAST_ROWS)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
        g = ((p - y) * weight).astype(np.float32)
        vw = 0.9 * vw - step * (x.T @ g + decay * w)
        vb = 0.9 * vb - step * float(g.sum())
        w, b = w + vw, b + vb
    return w, b


class Model(NamedTuple):
    weak: Weak
    weights: np.ndarray
    bias: float


def fit(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    scratch = Scratch(spark, "quality")
    text = docs.select(F.xxhash64(F.lit(3), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                s = statistics(data, at)
                some = s["words"] > 0
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), pa.array(pattern(votes(s))[some])], names=["h", "pattern"])

    cast = scratch.keep(text.mapInArrow(vote, "h long, pattern long"), "votes")
    counted = cast.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    v, n = unpattern(np.array([r.pattern for r in counted])), np.array([r.n for r in counted], float)
    weak = expectation_maximisation(v, n)
    junk = [r.pattern for r, p in zip(counted, posterior(weak, v), strict=True) if p > 0.5]
    kind = F.col("pattern").isin(junk)
    # half of the sample from either kind, the first in hash order; thresholds instead of a sort of all rows
    chosen = None
    for side in (kind, ~kind):
        rows = cast.filter(side)
        part = rows.orderBy("h", "pattern").limit(sample_rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.select("h", "pattern").distinct()

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                rows = [r.tobytes() for r in features(data, at)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["h", "pattern", "x"])

    picked = text.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("h", "pattern", "text").mapInArrow(describe, "h long, pattern long, x binary")
    rows = sorted((r.h, r.pattern, bytes(r.x)) for r in picked.collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), DIMENSIONS)
    y = posterior(weak, unpattern(np.array([r[1] for r in rows])))
    return Model(weak, *train(x, y))


def judge(docs: DataFrame, model: Model | None, reject_above: float = REJECT_ABOVE, verdict: str | None = None) -> DataFrame:
    """doc_id, quality (probability of clean), weak_junk (the labellers' posterior), kept.

    verdict: all columns of docs instead, and one of that name that says whether the row is kept.
    """
    # mapInArrow resolves columns by name, dots and all, so they get plain ones for it
    plain = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    rows = docs.toDF(*plain) if verdict else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                s = statistics(data, at)
                some = s["words"] > 0
                clean, weak = np.zeros(part.num_rows), np.ones(part.num_rows)
                if model is not None:
                    score = features(data, at) @ model.weights + model.bias
                    clean = np.where(some, 1 / (1 + np.exp(np.clip(score, -60, 60))), 0.0)
                    weak = np.where(some, posterior(model.weak, votes(s)), 1.0)
                kept = pa.array(some & (1 - clean <= reject_above))
                if verdict:
                    yield pa.RecordBatch.from_arrays([*part.columns, kept], names=[*part.schema.names, "verdict"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean.astype(np.float64)), pa.array(weak), kept], names=["doc_id", "quality", "weak_junk", "kept"])

    if not verdict:
        return rows.mapInArrow(work, "doc_id long, quality double, weak_junk double, kept boolean")
    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("verdict", BooleanType())])).toDF(*docs.columns, verdict)


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    (verdict,) = unused(docs, "verdict")
    return judge(docs, fit(spark, docs), verdict=verdict).filter(named(verdict)).drop(verdict)
