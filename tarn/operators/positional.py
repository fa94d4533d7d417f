"""Operators on positions: phrases, proximity, and sets of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.index import Index
from tarn.operators.rankers import ranked


def stem_positions(index: Index, stems: DataFrame | list[str]) -> DataFrame:
    """(stem, doc_id, pos) of some stems, over all their words; a document that stands there twice counts once."""
    return index.positions(stems).distinct()


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """phrases(query_id, stems array) to (query_id, doc_id, score): how often the stems stand side by side.

    Each occurrence of a stem votes for the place where the phrase would begin; a place with a vote from
    every stem is a match.  So a phrase of any length is one equi-join and one aggregation.
    """
    wanted = phrases.filter(F.size("stems") > 0).select("query_id", F.size("stems").alias("n"), F.posexplode("stems").alias("k", "stem"))
    found = stem_positions(index, wanted.select("stem").distinct())
    starts = found.join(wanted, "stem").groupBy("query_id", "doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(
        F.count_distinct("k").alias("hit"), F.first("n").alias("n")
    )
    return starts.filter("hit = n").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def phrase_search(index: Index, phrases: DataFrame, k: int | None = 10) -> DataFrame:
    return ranked(phrase_matches(index, phrases), k)


def combined_search(base: DataFrame, matches: DataFrame) -> DataFrame:
    """A ranking filtered by phrase matches; queries in which nothing survives keep the whole ranking."""
    flagged = base.join(matches.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    flagged = flagged.withColumn("any_hit", F.max("hit").over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    kept = flagged.filter(F.col("hit").isNotNull() | F.col("any_hit").isNull())
    return kept.select("query_id", "doc_id", "score", F.row_number().over(order).alias("rank"))


def spans(index: Index, groups: DataFrame) -> DataFrame:
    """groups(query_id, stems array) to (query_id, doc_id, span): the least distance that holds all stems, any order.

    For each occurrence, the last position of every stem so far is carried along; the span there is the
    occurrence less the least of them.
    """
    wanted = groups.select("query_id", F.array_distinct("stems").alias("stems"))
    longest = wanted.agg(F.max(F.size("stems"))).first()[0] or 0
    parts = wanted.select("query_id", F.size("stems").alias("n"), F.posexplode("stems").alias("k", "stem"))
    found = stem_positions(index, parts.select("stem").distinct()).join(parts, "stem")
    line = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = [F.max(F.when(F.col("k") == i, F.col("pos"))).over(line).alias(f"last{i}") for i in range(longest)]
    seen = found.select("query_id", "doc_id", "pos", "n", F.array(*[x for x in lasts]).alias("lasts"))
    full = seen.withColumn("lasts", F.filter(F.slice("lasts", F.lit(1), F.col("n")), lambda x: x.isNotNull())).filter(F.size("lasts") == F.col("n"))
    return full.groupBy("query_id", "doc_id").agg(F.min(F.col("pos") - F.array_min("lasts")).alias("span"))


def near(index: Index, groups: DataFrame) -> DataFrame:
    """groups(query_id, stems, window): documents in which all stems lie within a window."""
    return spans(index, groups).join(groups.select("query_id", "window"), "query_id").filter("span <= window").select("query_id", "doc_id")
