"""Services over the vocabulary: completion, spelling suggestions, prefix search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def autocomplete(vocabulary: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """The k words with the prefix that most documents have; a prefix of one letter has none."""
    if len(prefix or "") < 2:
        return vocabulary.select("word", "df").limit(0)
    return vocabulary.filter(F.col("word").startswith(prefix.lower())).select("word", "df").orderBy(F.desc("df"), "word").limit(k)


def suggestions(unknown: DataFrame, known: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """(stem, suggestion, distance, place): known stems with the same three first letters, nearest first.

    The prefix is an equi-join key, so no stem is compared with the whole vocabulary.
    """
    left = unknown.filter(F.length("stem") >= 3).select("stem", F.substring("stem", 1, 3).alias("prefix"))
    right = known.select(F.col("stem").alias("suggestion"), F.substring("stem", 1, 3).alias("prefix")).filter(F.length("prefix") == 3).distinct()
    pairs = left.join(right, "prefix").withColumn("distance", F.levenshtein("stem", "suggestion", distance)).filter("distance >= 0")
    order = Window.partitionBy("stem").orderBy("distance", "suggestion")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("stem", "suggestion", "distance", "place")


def wildcard_stems(vocabulary: DataFrame, prefix: str) -> DataFrame:
    """Stems of the words with a prefix."""
    return vocabulary.filter(F.col("word").startswith(prefix.lower())).select("stem").distinct()
