"""Readers: articles, topics, judgments, runs, stop words, and stored models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import pmcid_of, type_of

#: Where the fields of an article stand.
ARTICLE = "/article/front/article-meta"
FIELDS = {
    "title": f"{ARTICLE}/title-group/article-title",
    "abstract": f"{ARTICLE}/abstract",
    "body": "/article/body",
    "journal": "/article/front/journal-meta/journal-title-group/journal-title",
    "publisher": "/article/front/journal-meta/publisher/publisher-name",
}
LISTS = {
    "authors": f"{ARTICLE}/contrib-group/contrib[@contrib-type='author']/name",
    "categories": f"{ARTICLE}/article-categories//subj-group/subject",
}


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every .nxml file below a folder: path, doc_id (file name), type, and the seven fields.

    The text is parsed as a whole, since an XML row reader would lose the order of mixed content.  Paragraphs
    and section titles are joined by a space.  A missing field is empty.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nxml").load(folder)
        .select("path", F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)<!DOCTYPE[^>]*>", "").alias("xml"))
        .withColumn("xml", F.regexp_replace("xml", r"</(p|title|td|th|li|label|surname|given-names)>", " </$1>"))
    )
    one = {n: F.trim(F.regexp_replace(F.coalesce(F.expr(f"xpath_string(xml, \"{p}\")"), F.lit("")), r"\s+", " ")).alias(n) for n, p in FIELDS.items()}
    many = {n: F.filter(F.transform(F.expr(f"xpath(xml, \"{p}//text()\")"), lambda x: F.trim(x)), lambda x: x != "").alias(n) for n, p in LISTS.items()}
    return raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), type_of(F.col("path")).alias("type"), *one.values(), *many.values())


def as_documents(found: DataFrame) -> DataFrame:
    """Articles as (doc_id, text, head, path, type) and their fields: text has these in index order, so that phrases may straddle them."""
    text = F.concat_ws(" ", "title", "abstract", "body", "journal", "publisher", F.concat_ws(" ", "authors"), F.concat_ws(" ", "categories"))
    return found.select("doc_id", text.alias("text"), F.concat_ws(" ", "title", "abstract").alias("head"), "path", "type", *FIELDS, *LISTS)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(number, type, description, summary)."""
    schema = "_number int, _type string, description string, summary string"
    return spark.read.format("xml").option("rowTag", "topic").schema(schema).load(path).select(
        F.col("_number").alias("number"), F.col("_type").alias("type"), "description", "summary"
    )


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, doc_id, rel) from folders type/Topic_n/grade/file; of a document judged twice the higher grade counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nxml").load(folder).select("path")
    rows = files.select(
        F.regexp_extract("path", r"(?i)/topic_(\d+)/\d+/[^/]+$", 1).alias("topic"), F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).alias("grade"), pmcid_of(F.col("path")).alias("doc_id")
    ).filter("topic != ''")
    return rows.groupBy(F.col("topic").cast("int").alias("query_id"), "doc_id").agg(F.max(F.col("grade").cast("int")).alias("rel"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated judgment file: (query_id, doc_id, rel)."""
    return spark.read.schema("query_id int, iter int, doc_id string, rel int").option("sep", "\t").csv(path).drop("iter")


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """A run file: (query_id, doc_id, rank, score, model)."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).filter("trim(value) != ''").select(
        parts[0].cast("int").alias("query_id"), parts[2].alias("doc_id"), parts[3].cast("int").alias("rank"), parts[4].cast("double").alias("score"), parts[5].alias("model")
    )


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """A word per line, trimmed and lower-cased, a byte order mark stripped; a missing file has none.  Lists are small by nature."""
    if not exists(spark, path):
        return []
    word = F.lower(F.trim(F.regexp_replace("value", "^\ufeff", "")))
    return sorted(r.w for r in spark.read.text(path).select(word.alias("w")).filter("w != ''").distinct().collect())


def latent(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """A stored latent model, (documents, stems); None where there is none or it can't be read."""
    if not (exists(spark, f"{path}/documents") and exists(spark, f"{path}/stems")):
        return None
    try:
        documents, stems = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/stems")
        return documents.select("doc_id", "v"), stems.select("stem", "idf", "v")
    except AnalysisException:
        return None


def weights(spark: SparkSession, path: str) -> list[float] | None:
    """Stored ranking weights; None where there are none or not one for each feature."""
    if not exists(spark, path):
        return None
    try:
        rows = sorted((r.feature, r.weight) for r in spark.read.parquet(path).select("feature", "weight").limit(100).collect())
    except AnalysisException:
        return None
    return [w for _, w in rows] if [i for i, _ in rows] == list(range(5)) else None


def query_string(column):
    """The parameters of a URL query string as a map; names and values are decoded once."""
    pairs = F.filter(F.split(F.coalesce(column, F.lit("")), "&"), lambda x: x != "")
    return F.map_from_entries(
        F.transform(pairs, lambda x: F.struct(F.url_decode(F.substring_index(x, "=", 1)), F.url_decode(F.when(F.instr(x, "=") > 0, x.substr(F.instr(x, "=") + 1, F.length(x))).otherwise(""))))
    )
