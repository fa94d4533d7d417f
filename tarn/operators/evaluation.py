"""Retrieval metrics over runs and judgments, and a paired significance test."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 11


def totals(qrels: DataFrame) -> DataFrame:
    """(query_id, num_rel) of every judged query."""
    return qrels.groupBy("query_id").agg(F.sum((F.col("rel") >= 1).cast("int")).alias("num_rel"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run(model, query_id, doc_id, score, rank) of judged queries, with rel, running relevant count and that query's total."""
    known = run.join(totals(qrels), "query_id").join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    line = Window.partitionBy("model", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("hit", (F.col("rel") >= 1).cast("int")).withColumn("hits", F.sum("hit").over(line))


def every_query(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """(model, query_id, num_rel) for each model, those of the run unless given, and each judged query, found or not."""
    if models is None:
        names = run.select("model").distinct()
    else:
        names = run.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return totals(qrels).crossJoin(F.broadcast(names))  # names: a handful of models


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _gain(rel: Column, rank: Column) -> Column:
    return rel * F.lit(math.log(2.0)) / F.log(rank + 1.0)


def ideal(qrels: DataFrame) -> DataFrame:
    """(query_id, idcg5, idcg10) from all judgments."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    best = qrels.withColumn("place", F.row_number().over(order)).filter("place <= 10")
    g = _gain(F.col("rel"), F.col("place"))
    return best.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= 5, g).otherwise(0.0)).alias("idcg5"), F.sum(g).alias("idcg10"))


def metrics(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """A row per model and judged query, all metrics rounded to six places; 0 where a model found nothing."""
    rows = judged(run, qrels)

    def hits(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))

    g = _gain(F.col("rel"), F.col("rank"))
    sums = rows.groupBy("model", "query_id").agg(
        F.count("*").alias("num_ret"), F.sum("hit").alias("num_rel_ret"),
        hits(5).alias("h5"), hits(10).alias("h10"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(F.col("rank") <= 5, g).otherwise(0.0)).alias("dcg5"), F.sum(F.when(F.col("rank") <= 10, g).otherwise(0.0)).alias("dcg10"),
        F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("hit")).otherwise(0)).alias("hr"),
    )
    sums = every_query(run, qrels, models).join(sums, ["model", "query_id"], "left").na.fill(0).join(ideal(qrels), "query_id")
    r = F.col("num_rel")
    p5, p10 = F.col("h5") / 5, F.col("h10") / 10
    r5, r10 = (F.when(r > 0, F.col(h) / r).otherwise(0.0) for h in ("h5", "h10"))
    out = {
        "p5": p5, "p10": p10, "r5": r5, "r10": r10, "f5": _harmonic(p5, r5), "f10": _harmonic(p10, r10),
        "ap": F.when(r > 0, F.col("ap_sum") / r).otherwise(0.0),
        "ndcg5": F.when(F.col("idcg5") > 0, F.col("dcg5") / F.col("idcg5")).otherwise(0.0),
        "ndcg10": F.when(F.col("idcg10") > 0, F.col("dcg10") / F.col("idcg10")).otherwise(0.0),
        "rprec": F.when(r > 0, F.col("hr") / r).otherwise(0.0),
    }
    return sums.select("model", "query_id", "num_rel", "num_ret", "num_rel_ret", *(F.round(c, 6).alias(n) for n, c in out.items()))


MEASURES = ("p5", "p10", "r5", "r10", "f5", "f10", "ap", "ndcg5", "ndcg10", "rprec")


def means(measured: DataFrame) -> DataFrame:
    """A row per model: the number of queries and the mean of each metric."""
    return measured.groupBy("model").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in MEASURES))


def curve(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """(model, query_id, level, precision): interpolated at recall 0, 0.1 .. 1, for every judged query with a relevant document."""
    levels = every_query(run, qrels, models).filter("num_rel > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    rows = levels.join(judged(run, qrels).drop("num_rel"), ["model", "query_id"], "left")
    reached = F.col("hits") / F.col("num_rel") >= F.col("level") / 10 - 1e-9
    return rows.groupBy("model", "query_id", "level").agg(F.round(F.max(F.when(reached, F.col("hits") / F.col("rank")).otherwise(0.0)), 6).alias("precision"))


def mean_curve(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    return curve(run, qrels, models).groupBy("model", "level").agg(F.round(F.avg("precision"), 6).alias("precision"))


#: Abramowitz and Stegun 26.2.17.
_P, _COEFFICIENTS = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + _P * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_COEFFICIENTS):
        poly = t * (c + poly)
    tail = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def wilcoxon(values: DataFrame) -> DataFrame:
    """values(model, query_id, ap) to (model_a, model_b, n, w, p) for each pair of models in name order.

    Differences up to 1e-10 are dropped, ties share their average rank, and p comes from the normal
    approximation without corrections; fewer than two differences give 1.
    """
    a = values.select(F.col("model").alias("model_a"), "query_id", F.col("ap").alias("va"))
    b = values.select(F.col("model").alias("model_b"), "query_id", F.col("ap").alias("vb"))
    pairs = a.join(b, "query_id").filter("model_a < model_b")
    names = pairs.select("model_a", "model_b").distinct()
    diffs = pairs.withColumn("d", F.round(F.col("va") - F.col("vb"), 10)).filter(F.abs("d") > 1e-10)
    group = Window.partitionBy("model_a", "model_b")
    ranks = F.rank().over(group.orderBy(F.abs("d"))) + (F.count("*").over(Window.partitionBy("model_a", "model_b", F.abs("d"))) - 1) / 2
    sums = diffs.withColumn("r", ranks).groupBy("model_a", "model_b").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down")
    )
    n, w = F.col("n"), F.least("up", "down")
    z = F.abs(w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return names.join(sums, ["model_a", "model_b"], "left").select(
        "model_a", "model_b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(w, F.lit(0.0)).alias("w"),
        F.round(F.when(F.coalesce(n, F.lit(0)) < 2, 1.0).otherwise(2 * (1 - normal_cdf(z))), 6).alias("p"),
    )


def comparison(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Pairs of models with mean AP of both, p, and its label."""
    measured = metrics(run, qrels, models)
    mean = means(measured).select("model", "ap")
    p = wilcoxon(measured.select("model", "query_id", "ap"))
    label = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    return p.join(mean.select(F.col("model").alias("model_a"), F.col("ap").alias("map_a")), "model_a").join(
        mean.select(F.col("model").alias("model_b"), F.col("ap").alias("map_b")), "model_b"
    ).select("model_a", "model_b", "map_a", "map_b", "p", label.alias("label"))
