"""An extension: keep a saved index up to date from a stream of new documents.

Each micro-batch is analysed and appended once: a batch that is replayed after a failure replaces the
folder of its number.  Document frequencies and norms depend on the whole collection, so refresh() derives
them anew from the appended postings.  A document that comes again in a later batch replaces what the earlier
one brought; one that comes twice in a batch counts twice, as in an index of a table that holds it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.functions.stemming import light_stem
from tarn.functions.text import STOPWORDS
from tarn.operators.index import Index


def index_stream(stream: DataFrame, path: str, checkpoint: str, stopwords=STOPWORDS, stem=light_stem) -> StreamingQuery:
    """stream(doc_id, text) to postings and lengths below path."""

    def append(batch: DataFrame, number: int) -> None:
        index = Index(batch, stopwords, stem)
        index.postings().write.mode("overwrite").parquet(f"{path}/incoming/postings/batch={number}")
        index.lengths().write.mode("overwrite").parquet(f"{path}/incoming/lengths/batch={number}")

    return stream.select("doc_id", "text").writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(docs: DataFrame, path: str, stopwords=STOPWORDS, stem=light_stem) -> Index:
    """The index over all that has come in; docs serves texts for snippets only."""
    spark = docs.sparkSession
    index = Index(docs, stopwords, stem)
    came = {name: spark.read.parquet(f"{path}/incoming/{name}") for name in ("postings", "lengths")}
    latest = came["lengths"].groupBy("doc_id").agg(F.max("batch").alias("batch"))  # every document has a length, if not a posting
    index._saved = {name: rows.join(latest, ["doc_id", "batch"], "left_semi").drop("batch") for name, rows in came.items()}
    return index
