"""Writers: run files, judgments, metric tables, curves, models and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.evaluation import MEASURES, mean_curve, means


def run_lines(run: DataFrame) -> DataFrame:
    """run(query_id, doc_id, score, rank, model) as lines: id Q0 doc rank score model."""
    return run.select(F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), "score", F.upper("model")).alias("value"))


def qrels_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws("\t", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rel").cast("string")).alias("value"))


def metric_rows(measured: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """A row per topic, and a last one of means, as strings with four decimals; `-` where a mean says nothing.

    types(query_id, type) adds a column type, in capitals.
    """
    def four(name: str) -> Column:
        return F.format_string("%.4f", F.round(name, 4)).alias(name)

    counts, kind = ("num_rel", "num_ret", "num_rel_ret"), []
    if types is not None:
        measured = measured.join(types.select("query_id", F.upper("type").alias("type")), "query_id", "left")
        kind = [F.coalesce("type", F.lit("-")).alias("type")]
    rows = measured.select("model", F.col("query_id").cast("string").alias("topic"), *kind, *(F.col(c).cast("string").alias(c) for c in counts), *(four(m) for m in MEASURES))
    last = [F.lit("-").alias("type")] if kind else []
    return rows.unionByName(means(measured).select("model", F.lit("MAP/Avg").alias("topic"), *last, *(F.lit("-").alias(c) for c in counts), *(four(m) for m in MEASURES)))


def curve_json(run: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One row (value): recall levels and each model's curve as JSON."""
    by_model = mean_curve(run, qrels, models).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "precision"))), lambda x: x["precision"]).alias("curve"))
    curves = by_model.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "curve")))).alias("curves"))
    return curves.select(F.to_json(F.struct(F.array(*[F.lit(i / 10) for i in range(11)]).alias("recall_levels"), "curves")).alias("value"))


def result_rows(results: DataFrame) -> DataFrame:
    """(rank, doc_id, score, type, snippet) of a result list, in order, for write_csv."""
    return results.select("rank", "doc_id", F.format_string("%.6f", "score").alias("score"), "type", "snippet").orderBy("rank")


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", sep == ",").option("sep", sep).csv(path)


def write_latent(documents: DataFrame, stems: DataFrame, path: str) -> None:
    """A latent model: vectors of documents (doc_id, v) and of stems (stem, idf, v)."""
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    stems.write.mode("overwrite").parquet(f"{path}/stems")


def write_weights(spark: SparkSession, weights: Sequence[float], path: str) -> None:
    """Ranking weights: one row per feature."""
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "feature int, weight double")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
