"""A training corpus from raw documents: judge, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder, gives what it reads back to the next and deletes what the one before has left.  All but the last return
the columns of documents, whatever these are named.

Defined results: an empty table gives an empty one in every stage.  Null, empty and blank texts go in the first
stage.  A null doc_id is an id like any: such rows are judged by their texts, and of equal texts a row with an id
stays rather than one without.  Of rows that repeat both id and text one stays in the second stage.  Texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import Scratch, released
from tarn.llm.exact_dedup import deduplicate
from tarn.llm.mixing import apply_mix
from tarn.llm.near_dedup import one_per_group
from tarn.llm.packing import pack_documents
from tarn.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; so do those without words."""
    return keep_good(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, a null id only where there is no other."""
    return deduplicate(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays: shingles of five words, similarity 0.8 or more."""
    return one_per_group(spark, docs, shingle=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a missing or null source is a source of its own."""
    return apply_mix(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a document that the mix took twice is packed twice."""
    return pack_documents(spark, docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", packing)]

#: Sketches, a trained scorer and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return docs
