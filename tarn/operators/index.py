"""The inverted index as tables: tokens, postings, vocabulary, document lengths and norms.

Positions count every word, stop words and numbers too, from 1.  Rankers ask an Index for the postings of
some stems; the filter goes below the aggregation, so only tokens that a query names are ever shuffled.  save()
writes every table that a ranker reads, and an index that was loaded derives nothing anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.stemming import Stemmer, as_stemmer, light_stem
from tarn.functions.text import STOPWORDS, is_index_word, words
from tarn.operators.scan import Scan

#: Bytes of documents for a task, where they are dealt, and documents that are left as they lie.
DEAL_BYTES, DEAL_ROWS = 16 << 20, 2_000
#: Tables of a saved index.
TABLES = ("postings", "vocabulary", "lengths", "statistics", "norms", "matrix", "stems", "matrix_norms")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows as they lie, or dealt by key where one task would read more than twice its share: a row group is not divided."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    lie = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    if sum(lie) < DEAL_ROWS or max(lie) * cores <= 2 * sum(lie):
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(min(sum(lie), max(2 * cores, -(-min(size, 1 << 42) // DEAL_BYTES))), key)


class Index:
    """Tables over docs(doc_id, text), each a lazy plan; an index written by save() reads them instead.

    Stems that a caller asks for are a DataFrame (stem), or a list, which reaches the Parquet scan as a filter.
    """

    def __init__(self, docs: DataFrame, stopwords=STOPWORDS, stem: Stemmer | Callable[[Column], Column] = light_stem):
        self.docs, self.stopwords, self.stem, self._saved, self._scan = docs, stopwords, as_stemmer(stem), {}, None
        self._texts: DataFrame | None = None

    def scan(self) -> Scan | None:
        """The passes over the texts that serve an index which is not stored; none for a stored one, ids that repeat and stemmers of columns."""
        if self._saved:
            return None
        if self._scan is None:
            self._scan = Scan(self)
        return self._scan if self._scan.possible() else None

    def texts(self) -> DataFrame:
        """(doc_id, text) in even tasks."""
        if self._texts is None:
            self._texts = dealt(self.docs.select("doc_id", "text"), "doc_id")
        return self._texts

    def analyse(self, table: DataFrame, key: str, text: Column, stems: list[str] | None = None) -> DataFrame:
        """(key, pos, word, stem) of all index words; with stems, at least those of these stems."""
        sought = sorted(set(stems)) if stems is not None and self.stem.prefix else []
        if sought:  # texts and words that cannot have such a stem are left out before any word is stemmed
            low = F.lower(text)
            table = table.filter(reduce(or_, [F.contains(low, F.lit(s)) for s in sought]))
        exploded = table.select(key, F.posexplode(words(text)).alias("pos", "word"))
        if sought:
            exploded = exploded.filter(reduce(or_, [F.startswith("word", F.lit(s)) for s in sought]))
        return exploded.filter(is_index_word(F.col("word"), self.stopwords)).select(
            key, (F.col("pos") + 1).alias("pos"), "word", self.stem(F.col("word")).alias("stem")
        )

    def _of(self, rows: DataFrame, stems: DataFrame | list[str] | None) -> DataFrame:
        if stems is None:
            return rows
        if isinstance(stems, DataFrame):
            if not self._saved:  # a table whose size is known: a few stems go to the tokens, which are not shuffled
                from tarn.operators.store import keep

                stems = keep(self.docs.sparkSession, stems.select("stem").distinct(), "stems")
            return rows.join(stems, "stem", "left_semi")
        return rows.filter(F.col("stem").isin(sorted(set(stems))))

    def tokens(self, stems: DataFrame | list[str] | None = None) -> DataFrame:
        """(doc_id, pos, word, stem) of all documents, or of the given stems."""
        named = stems if isinstance(stems, list) else None
        return self._of(self.analyse(self.texts(), "doc_id", F.col("text"), named), stems)

    def lengths(self) -> DataFrame:
        """(doc_id, dl); empty documents have 0."""
        if "lengths" in self._saved:
            return self._saved["lengths"]
        return self.docs.select("doc_id", F.size(words(F.col("text"))).alias("dl"))

    def statistics(self) -> DataFrame:
        """One row (n_docs, avgdl); empty documents count."""
        if "statistics" in self._saved:
            return self._saved["statistics"]
        if self._scan is not None and self._scan.has("counts"):
            return self._scan.statistics()
        return self.lengths().agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def frequencies(self, stems: DataFrame | list[str] | None = None) -> DataFrame:
        """(word, stem, doc_id, tf), of the given stems or of all."""
        if "postings" in self._saved:
            return self._of(self._saved["postings"].select("word", "stem", "doc_id", "tf"), stems)
        return self.tokens(stems).groupBy("word", "stem", "doc_id").agg(F.count("*").alias("tf"))

    def postings(self, stems: DataFrame | list[str] | None = None) -> DataFrame:
        """(word, stem, doc_id, tf, positions)."""
        if "postings" in self._saved:
            return self._of(self._saved["postings"], stems)
        return self.tokens(stems).groupBy("word", "stem", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))

    def positions(self, stems: DataFrame | list[str]) -> DataFrame:
        """(stem, doc_id, pos) of some stems, over all their words."""
        if "postings" in self._saved:
            return self.postings(stems).select("stem", "doc_id", F.explode("positions").alias("pos"))
        return self.tokens(stems).select("stem", "doc_id", "pos")

    def vocabulary(self, stems: DataFrame | list[str] | None = None) -> DataFrame:
        """(word, stem, df)."""
        if "vocabulary" in self._saved:
            return self._of(self._saved["vocabulary"], stems)
        return self.frequencies(stems).groupBy("word", "stem").agg(F.count("*").alias("df"))

    def norms(self) -> DataFrame:
        """(doc_id, norm): the length of the tf times ln(N / df) vector, 0 for a document without index words."""
        if "norms" in self._saved:
            return self._saved["norms"]
        n = self.statistics().select("n_docs")
        weights = self.frequencies().join(self.vocabulary().select("word", "df"), "word").crossJoin(F.broadcast(n))  # n: one row
        squares = weights.groupBy("doc_id").agg(F.sum(F.pow(F.col("tf") * F.log(F.col("n_docs").cast("double") / F.col("df")), 2)).alias("s"))
        return self.docs.select("doc_id").join(squares, "doc_id", "left").select("doc_id", F.sqrt(F.coalesce("s", F.lit(0.0))).alias("norm"))

    def stem_matrix(self, stems: DataFrame | list[str] | None = None) -> DataFrame:
        """(doc_id, stem, tf, df, w) with w = tf ln(N / df), both counted per stem."""
        if "matrix" in self._saved:
            return self._of(self._saved["matrix"], stems)
        tf = self.frequencies(stems).groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
        df = tf.groupBy("stem").agg(F.count("*").alias("df"))
        n = self.statistics().select("n_docs")
        return tf.join(df, "stem").crossJoin(F.broadcast(n)).select(  # n: one row
            "doc_id", "stem", "tf", "df", (F.col("tf") * F.log(F.col("n_docs").cast("double") / F.col("df"))).alias("w")
        )

    def stems(self) -> DataFrame:
        """(stem, df, first_df): in how many documents a stem occurs, and the df of its first word in order."""
        if "stems" in self._saved:
            return self._saved["stems"]
        if scan := self.scan():
            return scan.stems()
        df = self.stem_matrix().groupBy("stem").agg(F.first("df").alias("df"))
        return df.join(self.vocabulary().groupBy("stem").agg(F.min_by("df", "word").alias("first_df")), "stem")

    def matrix_norms(self) -> DataFrame:
        """(doc_id, dn): the length of a document's row in the stem matrix."""
        if "matrix_norms" in self._saved:
            return self._saved["matrix_norms"]
        return self.stem_matrix().groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))

    def save(self, path: str) -> Index:
        """Write all tables, and return the index that reads them.

        Postings and matrix lie in ranges of stems, so that a list of stems skips most row groups.
        """
        spark = self.docs.sparkSession
        built = Index(self.docs, self.stopwords, self.stem)

        def keep(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            built._saved[name] = spark.read.schema(rows.schema).parquet(f"{path}/{name}")

        keep("postings", self.postings().repartitionByRange("stem", "word", "doc_id").sortWithinPartitions("stem", "word", "doc_id"))
        keep("vocabulary", built._saved["postings"].groupBy("word", "stem").agg(F.count("*").alias("df")))
        keep("lengths", self.lengths())
        keep("statistics", built.statistics())
        keep("norms", built.norms())
        keep("matrix", built.stem_matrix().repartitionByRange("stem", "doc_id").sortWithinPartitions("stem", "doc_id"))
        keep("stems", built.stems())
        keep("matrix_norms", built.matrix_norms())
        return built

    @classmethod
    def load(cls, docs: DataFrame, path: str, stopwords=STOPWORDS, stem: Stemmer | Callable[[Column], Column] = light_stem) -> Index:
        """The index in a folder that save() wrote; stop words and stemmer have to be those it was built with."""
        index = cls(docs, stopwords, stem)
        index._saved = {name: docs.sparkSession.read.parquet(f"{path}/{name}") for name in TABLES}
        return index
