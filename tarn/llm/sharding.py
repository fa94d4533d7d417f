"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key is mapped to one of n shards by a few integer steps without a ring table.  Going from n to
n + 1 shards moves only the 1/(n + 1) of the keys that the new shard receives.

Law: `key`.  doc_id and the number of shards decide alone, so equal texts under different ids may part.
Places inside a shard are gapless.  Rows that agree in all that is reported are counted first and are one
entry from then on; a block is what falls on one remainder of the id's CRC-32, about 20,000 entries; places
come from the rows of the blocks before and a running sum inside the block, and an entry is unfolded again at
the end, a large one over all tasks.  So no task ever orders a whole shard or holds a key that many rows share.

Defined results: null text has size 1 and text_crc32 0; a null doc_id counts as key 0 and is placed before
other ids of its block; rows that agree in doc_id, size and text_crc32 take neighbouring slots in either
order; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Scratch, partitions
from tarn.llm.flat import mix64

BLOCK_ROWS = 20_000
#: Rows that agree are unfolded so many at a time.
UNFOLD_ROWS = 1000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys to 0 .. shards - 1."""
    key = np.asarray(keys, np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        k = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        key[moving] = k
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at.astype(np.int32)


def shard_of(shards: int):
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(jump(mix64(key.to_numpy(np.int64).view(np.uint64)), shards))

    return place


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, grown: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with `grown` shards, shards + 1 unless given)."""
    scratch = Scratch(spark, "shard")
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(shards)(key).alias("shard"),
        shard_of(grown or shards + 1)(key).alias("grown_shard"),
    )
    entries = scratch.keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "entries")
    blocks = max(1, math.ceil(entries.count() / BLOCK_ROWS))
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    entries = entries.withColumn("block", F.pmod(number, F.lit(blocks)).cast("int"))
    counts = entries.groupBy("shard", "block").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "block"])
    placed = placed.withColumn("from", F.col("base") + F.col("ahead"))
    few, many = placed.filter(F.col("n") <= UNFOLD_ROWS), placed.filter(F.col("n") > UNFOLD_ROWS)
    runs = many.withColumn("from", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1, F.lit(UNFOLD_ROWS).cast("long"))))
    runs = runs.withColumn("n", F.least(F.lit(UNFOLD_ROWS), F.col("base") + F.col("ahead") + F.col("n") - F.col("from")))
    runs = few.unionByName(runs.repartition(partitions(spark)))
    slots = runs.withColumn("slot", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
