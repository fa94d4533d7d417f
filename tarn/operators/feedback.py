"""Relevance feedback, similar documents and diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.index import Index
from tarn.operators.rankers import bm25

FEEDBACK_DOCS, NEW_TERMS, SIMILAR_CHARS, SIMILAR_TERMS, MMR_POOL = 3, 5, 600, 15, 30


def rocchio_terms(index: Index, terms: DataFrame, head: str = "text", docs: int = FEEDBACK_DOCS, new: int = NEW_TERMS) -> DataFrame:
    """(query_id, stem, weight, place): the new stems with the highest tf times BM25 idf in the best documents."""
    best = bm25(index, terms, docs).select("query_id", "doc_id")
    texts = best.join(index.docs.select("doc_id", F.col(head).alias("text")), "doc_id")
    tf = index.analyse(texts.withColumn("at", F.struct("query_id", "doc_id")), "at", F.col("text")).groupBy("at", "stem").agg(F.count("*").alias("tf"))
    n = index.statistics().select("n_docs")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    scored = tf.join(index.stems().select("stem", F.col("first_df").alias("df")), "stem").crossJoin(F.broadcast(n)).groupBy(F.col("at.query_id").alias("query_id"), "stem").agg(
        F.round(F.sum(F.col("tf") * idf / docs), 6).alias("weight")
    )
    fresh = scored.join(terms.select("query_id", "stem"), ["query_id", "stem"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "stem")
    return fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= new)


def expand(index: Index, terms: DataFrame, **how) -> DataFrame:
    """The query's terms and its new ones, each of those once."""
    return terms.unionByName(rocchio_terms(index, terms, **how).select("query_id", "stem", F.lit(1).cast("long").alias("qtf")))


def similar_terms(index: Index, sources: DataFrame, head: str = "text") -> DataFrame:
    """For each source as query_id: the 15 most frequent stems of its first 600 characters that tell documents apart."""
    chosen = index.docs.join(sources.select("doc_id"), "doc_id", "left_semi")
    heads = chosen.select(F.col("doc_id").alias("query_id"), F.substring(head, 1, SIMILAR_CHARS).alias("text"))
    tf = index.analyse(heads, "query_id", F.col("text")).groupBy("query_id", "stem").agg(F.count("*").alias("qtf"))
    n = index.statistics().select("n_docs")
    band = index.stems().crossJoin(F.broadcast(n)).filter("first_df > 1 and first_df < n_docs").select("stem")  # n: one row
    order = Window.partitionBy("query_id").orderBy(F.desc("qtf"), "stem")
    return tf.join(band, "stem").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SIMILAR_TERMS).drop("place")


def similar(index: Index, sources: DataFrame, k: int = 5, head: str = "text") -> DataFrame:
    """sources(doc_id) to (query_id, doc_id, score, rank): documents like each, itself left out."""
    found = bm25(index, similar_terms(index, sources, head), k + 1).filter(F.col("query_id") != F.col("doc_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vectors_of(index: Index, ranking: DataFrame) -> DataFrame:
    """(query_id, doc_id, stem, tf) of ranked documents: the raw counts that cosines are taken of."""
    wanted = ranking.select("query_id", "doc_id")
    if index.scan():  # from the texts of those documents alone
        texts = index.docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        return wanted.join(index.analyse(texts, "doc_id", F.col("text")).groupBy("doc_id", "stem").agg(F.count("*").alias("tf")), "doc_id")
    return wanted.join(index.stem_matrix().select("doc_id", "stem", "tf"), "doc_id")


def pair_cosines(index: Index, ranking: DataFrame) -> DataFrame:
    """(query_id, doc_a, doc_b, cosine) within each query's list; lists are bounded by their k."""
    v = vectors_of(index, ranking)
    norms = v.groupBy("query_id", "doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    a = v.select("query_id", F.col("doc_id").alias("doc_a"), "stem", F.col("tf").alias("ta"))
    b = v.select("query_id", F.col("doc_id").alias("doc_b"), "stem", F.col("tf").alias("tb"))
    dots = a.join(b, ["query_id", "stem"]).filter("doc_a < doc_b").groupBy("query_id", "doc_a", "doc_b").agg(F.sum(F.col("ta") * F.col("tb")).alias("s"))
    na = norms.select("query_id", F.col("doc_id").alias("doc_a"), F.col("norm").alias("na"))
    nb = norms.select("query_id", F.col("doc_id").alias("doc_b"), F.col("norm").alias("nb"))
    return dots.join(na, ["query_id", "doc_a"]).join(nb, ["query_id", "doc_b"]).select(
        "query_id", "doc_a", "doc_b", F.round(F.col("s") / (F.col("na") * F.col("nb")), 6).alias("cosine")
    )


def diversify(index: Index, ranking: DataFrame, weight: float = 0.7, k: int = 10) -> DataFrame:
    """Maximal marginal relevance, greedily over the best 30 of each query: (query_id, doc_id, score, rank)."""
    pool = ranking.filter(F.col("rank") <= MMR_POOL)
    vectors = vectors_of(index, pool).groupBy("query_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "tf"))).alias("v"))

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        maps = [dict(v) if v is not None else {} for v in rows["v"]]
        norms = [np.sqrt(sum(x * x for x in m.values())) for m in maps]
        best = rows["score"].iloc[0] if rows["score"].iloc[0] > 0 else 1.0
        left, taken, out = list(range(len(rows))), [], []
        likeness = np.zeros(len(rows))
        while left and len(taken) < k:
            value = {i: round(weight * rows["score"][i] / best - (1 - weight) * likeness[i], 9) for i in left}
            top = max(left, key=lambda i: (value[i], -i))
            left.remove(top)
            taken.append(top)
            out.append((rows["query_id"][top], rows["doc_id"][top], rows["score"][top], len(taken)))
            for i in left:
                small, big = sorted((maps[i], maps[top]), key=len)
                d = sum(x * big.get(s, 0) for s, x in small.items())
                likeness[i] = max(likeness[i], d / (norms[i] * norms[top]) if norms[i] and norms[top] else 0.0)
        return pd.DataFrame(out, columns=["query_id", "doc_id", "score", "rank"])

    kinds = dict(ranking.dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int"
    return pool.join(vectors, ["query_id", "doc_id"], "left").groupBy("query_id").applyInPandas(choose, schema)
