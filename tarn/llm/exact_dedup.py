"""Exact deduplication against a persistent digest index.

The index is a Spark table bucketed and sorted by the SHA-256 digest of the text.  A batch of documents is
reduced to one row per digest, sort-merge anti-joined with the index, and what is new is appended; as the
table is bucketed, only the batch is shuffled.  Texts never leave the scan: all that moves is 32 bytes of
digest and an id per row.

Every entry names the batch that brought it.  A batch that is sent again, after a job that died between the
append and the caller's own output, finds its own entries and gives the same answer as the first time.  The
number of buckets is written beside the table, so that sessions with other settings append to it as it is.
One writer at a time.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays (a null
doc_id stays only if all are null); rows that repeat both text and doc_id of the row that stays are all
reported as kept, and deduplicate() leaves one of them; an empty table gives an empty report; columns of
the input other than doc_id and text are ignored by the report.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Scratch, join_hot, named, partitions, shared_dir, unused


class DigestIndex:
    """digest binary, keep_id long, batch string: one row for each text ever seen.

    path is a folder in a store that all sessions share; opened there again, it is the same index.  buckets
    counts only where the index is new.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.path = path or f"{shared_dir(spark)}/{name}"
        note = f"{self.path}/buckets"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(note)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.buckets = int(spark.read.text(note).first()[0])
        else:
            self.buckets = buckets or partitions(spark)
            spark.createDataFrame([(str(self.buckets),)], "value string").coalesce(1).write.mode("overwrite").text(note)
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add those digests of groups(digest, keep_id) that the index lacks."""
        dealt = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        fresh = dealt.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the table; the folder is the caller's."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"),
    )


def _groups(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("digest", *more).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_report(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index, keep_id of a text that an earlier batch brought is the id that the index has, and no row of
    this batch is kept; group_size counts the rows of the batch.  batch names it; unless given, its rows do,
    in any order.  Without an index the table is loaded into a new one in two batches, the larger half of the
    ids first, so that the smaller half is deduplicated against it.
    """
    scratch = Scratch(spark, "exact")
    rows = scratch.keep(digests(docs), "rows")
    about = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
    if index is None:
        own = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", f"{scratch.path}/index")
        middle = (rows.approxQuantile("doc_id", [0.5], 0.1) or [0.0])[0]
        late = F.coalesce(F.col("doc_id") > int(middle), F.lit(False))
        # written, so that a join finds one row per digest and no optimiser joins before it aggregates
        groups = scratch.keep(_groups(rows.withColumn("late", late), "late"), "groups", few=True)
        own.append(groups.filter("late"), "late")
        own.append(groups.filter("not late"), "early")
        sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
        resolved = scratch.keep(sizes.join(own.read().select("digest", "keep_id").hint("merge"), "digest").withColumn("known", F.lit(False)), "resolved", few=True)
        own.drop()
        scratch.drop("index", "groups")
    else:
        batch = batch or f"{about[0]}:{about[1]}"
        groups = scratch.keep(_groups(rows), "groups", few=True)
        index.append(groups, batch)
        entries = index.read().withColumn("known", F.col("batch") != batch).drop("batch")
        resolved = scratch.keep(groups.drop("keep_id").join(entries.hint("merge"), "digest"), "resolved", few=True)
        scratch.drop("groups")
    return join_hot(rows, resolved, ["digest"], "group_size", about[0]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    scratch = Scratch(spark, "exact-kept")
    of, own, times, mine, other = unused(docs, "of", "own", "times", "mine", "other")
    kept = scratch.keep(exact_report(spark, docs, index, batch).filter("kept").select("doc_id", "text_sha256"), "kept", few=True)
    stay = kept.groupBy(F.col("doc_id").alias(of), F.unhex("text_sha256").alias(own)).agg(F.count("*").alias(times))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    tagged = docs.withColumns({mine: digest, other: F.col("doc_id").cast("long")})
    out = tagged.join(stay.drop(times), F.col(other).eqNullSafe(F.col(of)) & (F.col(mine) == F.col(own)), "left_semi")
    if not stay.filter(F.col(times) > 1).isEmpty():
        out = out.dropDuplicates([other, mine])
    return out.select(*(named(c) for c in docs.columns))
