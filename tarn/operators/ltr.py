"""Learning to rank: a linear model over five features, trained by coordinate ascent on mean average precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = ["f0", "f1", "f2", "f3", "f4"]
#: Steps of a weight, in the order in which they are tried.
STEPS = (0.5, 0.2, 0.1, 0.05, -0.05, -0.1, -0.2, -0.5)
PASSES, GAIN, RESTARTS = 40, 1e-6, 5


def training_data(feats: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, label, f0 .. f4) of the pool; label 1 for grade 1 or more."""
    return feats.join(qrels, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", (F.coalesce("rel", F.lit(0)) >= 1).cast("int").alias("label"), *FEATURES
    )


def pool_map(data: DataFrame, weights: list[float]) -> DataFrame:
    """One row (map): mean over queries with a relevant document of AP within the pool."""
    score = F.round(sum((F.col(f) * w for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0)), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    ranked = data.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ap = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"), F.sum("label").alias("n"))
    return ap.filter("n > 0").agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("map"))


def _map(groups: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> float:
    total, n = 0.0, 0
    for x, y in groups:
        if y.any():
            hit = y[np.argsort(-np.round(x @ w, 6), kind="stable")]
            total += (np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit == 1].mean()
            n += 1
    return total / n if n else 0.0


def ascend(groups: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray) -> tuple[np.ndarray, float]:
    """One weight after the other takes the step that helps most, until none does; then the sum becomes 1."""
    w = np.array(start, float)
    for _ in range(PASSES):
        moved = False
        for i in range(len(w)):
            best, value = w[i], _map(groups, w)
            for step in STEPS:
                trial = w.copy()
                trial[i] = max(0.0, w[i] + step)
                if (reached := _map(groups, trial)) > value + GAIN:
                    best, value, moved = trial[i], reached, True
            w[i] = best
        if not moved:
            break
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    return w, _map(groups, w)


def train(spark: SparkSession, data: DataFrame, restarts: int = RESTARTS, seed: int = 42) -> DataFrame:
    """(restart, map, w0 .. w4), a task per restart, each with the whole pool: at most 150 documents of each judged query."""
    rng = np.random.default_rng(seed)
    starts = [np.ones(len(FEATURES)), *(rng.random(len(FEATURES)) for _ in range(restarts - 1))]
    starts = [s / s.sum() for s in starts]
    rows = spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(starts)], "restart int, start array<double>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_id", "doc_id"])
        groups = [(g[FEATURES].to_numpy(), g["label"].to_numpy()) for _, g in pdf.groupby("query_id")]
        w, value = ascend(groups, np.array(pdf["start"].iloc[0]))
        return pd.DataFrame([[int(pdf["restart"].iloc[0]), float(value), *map(float, w)]], columns=["restart", "map", "w0", "w1", "w2", "w3", "w4"])

    return data.crossJoin(F.broadcast(rows)).groupBy("restart").applyInPandas(fit, "restart int, map double, w0 double, w1 double, w2 double, w3 double, w4 double")


def best_weights(trained: DataFrame) -> list[float]:
    top = trained.orderBy(F.desc("map"), "restart").first()
    return [top[f"w{i}"] for i in range(len(FEATURES))]
