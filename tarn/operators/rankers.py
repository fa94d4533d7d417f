"""Rankers over batches of queries: one plan for all of them.

A ranker takes queries as terms(query_id, stem, qtf) and returns (query_id, doc_id, score, rank), scores
rounded to six places, ordered by score and then doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.index import Index
from tarn.operators.store import keep
from tarn.operators.vocabulary import suggestions

K1, B, RRF_K, PLACES = 1.5, 0.75, 60, 6


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """queries(query_id, text) to (query_id, stem, qtf)."""
    return index.analyse(queries, "query_id", F.col("text")).groupBy("query_id", "stem").agg(F.count("*").alias("qtf"))


def substitute_unknown(index: Index, terms: DataFrame) -> DataFrame:
    """Stems that the vocabulary lacks become the known stems nearest in spelling, each with the stem's qtf."""
    known = index.stems().select("stem")
    unknown = terms.join(known, "stem", "left_anti")
    near = suggestions(unknown.select("stem").distinct(), known)
    return terms.join(known, "stem", "left_semi").unionByName(
        unknown.join(near, "stem").select("query_id", F.col("suggestion").alias("stem"), "qtf")
    ).groupBy("query_id", "stem").agg(F.sum("qtf").alias("qtf"))


def _matches(index: Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies of the words that the terms name, with df and the collection's statistics."""
    stems = terms.select("stem").distinct()
    return index.frequencies(stems).join(index.vocabulary(stems).select("word", "df"), "word"), index.statistics()


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    """Rank (query_id, doc_id, score) and keep the first k of each query."""
    if k is not None and k < 1:
        raise ValueError("k is 1 or more")
    rounded = scores.withColumn("score", F.round("score", PLACES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = rounded.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def bm25(index: Index, terms: DataFrame, k: int | None = 10) -> DataFrame:
    """Okapi BM25 per surface word; how often a query repeats a word does not matter."""
    if k is not None and k > 0 and (scan := index.scan()):
        return ranked(scan.scores("bm25", terms, k), k)
    found, stats = _matches(index, terms)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    length = 1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))
    weighted = found.join(index.lengths(), "doc_id").crossJoin(F.broadcast(stats)).select(  # stats: one row
        "stem", "doc_id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)).alias("w")
    )
    scores = weighted.join(terms.select("query_id", "stem"), "stem").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    return ranked(scores, k)


def vsm(index: Index, terms: DataFrame, k: int | None = 10) -> DataFrame:
    """tf-idf product over the document's norm; the query has none, so scores may exceed 1."""
    if k is not None and k > 0 and (scan := index.scan()):
        return ranked(scan.scores("vsm", terms, k), k)
    found, stats = _matches(index, terms)
    idf = F.log(F.col("n_docs").cast("double") / F.col("df"))
    weighted = found.crossJoin(F.broadcast(stats)).select("stem", "doc_id", (idf * idf * F.col("tf")).alias("w"))
    sums = weighted.join(terms, "stem").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("s"))
    score = F.when(F.col("norm") > 0, F.col("s") / F.col("norm")).otherwise(0.0)
    return ranked(sums.join(index.norms(), "doc_id").select("query_id", "doc_id", score.alias("score")), k)


def tfidf_cosine(index: Index, terms: DataFrame, k: int | None = 10) -> DataFrame:
    """Cosine of stem tf-idf vectors, positive ones only: what latent semantic ranking is at full rank."""
    if k is not None and k > 0 and (scan := index.scan()):
        return ranked(scan.scores("semantic", terms, k), k)
    known = index.stems().select("stem", "df").crossJoin(F.broadcast(index.statistics().select("n_docs")))  # statistics: one row
    query = terms.join(known, "stem").select(
        "query_id", "stem", (F.col("qtf") * F.log(F.col("n_docs").cast("double") / F.col("df"))).alias("qw")
    )
    norms = query.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    matrix = index.stem_matrix(terms.select("stem").distinct()).select("doc_id", "stem", "w")
    sums = query.join(matrix, "stem").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    scores = sums.join(index.matrix_norms(), "doc_id").join(norms, "query_id").filter("dn > 0 and qn > 0").select(
        "query_id", "doc_id", (F.col("s") / (F.col("dn") * F.col("qn"))).alias("score")
    )
    return ranked(scores.filter("score > 0"), k)


def fuse(rankings: list[DataFrame], k: int | None = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, 1 / (60 + rank) summed."""
    lists = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        lists = lists.unionByName(other.select("query_id", "doc_id", "rank"))
    scores = lists.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return ranked(scores, k)


def pool_size(k: int, kind: str = "hybrid") -> int:
    return max(k, 50) if kind == "hybrid" else max(3 * k, 50)


def features(bm: DataFrame, vs: DataFrame, sem: DataFrame) -> DataFrame:
    """(query_id, doc_id, f0 .. f4): BM25 and VSM over their best, cosine, reciprocal ranks; 0 where absent."""
    best = Window.partitionBy("query_id")

    def over_best(score: str) -> Column:
        top = F.max(score).over(best)
        return F.when(top > 0, F.col(score) / top).otherwise(0.0)

    zero = F.lit(0.0)
    rows = (
        bm.select("query_id", "doc_id", over_best("score").alias("f0"), zero.alias("f1"), zero.alias("f2"), (1.0 / F.col("rank")).alias("f3"), zero.alias("f4"))
        .unionByName(vs.select("query_id", "doc_id", zero.alias("f0"), over_best("score").alias("f1"), zero.alias("f2"), zero.alias("f3"), zero.alias("f4")))
        .unionByName(sem.select("query_id", "doc_id", zero.alias("f0"), zero.alias("f1"), F.col("score").alias("f2"), zero.alias("f3"), (1.0 / F.col("rank")).alias("f4")))
    )
    return rows.groupBy("query_id", "doc_id").agg(*(F.max(f).alias(f) for f in ("f0", "f1", "f2", "f3", "f4")))


def linear(feats: DataFrame, weights: list[float], k: int | None = 10) -> DataFrame:
    """Score by the weighted sum of the features."""
    score = sum((F.col(f"f{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
    return ranked(feats.select("query_id", "doc_id", score.alias("score")), k)


def filter_type(results: DataFrame, types: DataFrame, wanted: str | DataFrame | None, k: int, page: int = 1) -> DataFrame:
    """Cut to the documents of a type after the over-fetch of 20 k, then to a page of k; null or 'all' keeps every type.

    wanted is one type, or (query_id, type) for each query.  The filter stays above the first limit: pushed below,
    it would give other results.
    """
    fetched = results.filter(F.col("rank") <= 20 * k * page)
    if isinstance(wanted, DataFrame):
        asked = wanted.select("query_id", F.lower("type").alias("asked"))
        fetched = fetched.join(types, "doc_id", "left").join(asked, "query_id", "left").filter(
            F.col("asked").isNull() | (F.col("asked") == "all") | (F.lower("type") == F.col("asked"))
        )
    elif wanted is not None and wanted.lower() != "all":
        fetched = fetched.join(types, "doc_id").filter(F.lower("type") == wanted.lower())
    order = Window.partitionBy("query_id").orderBy("rank")
    placed = fetched.withColumn("rank", F.row_number().over(order))
    return placed.filter((F.col("rank") > k * (page - 1)) & (F.col("rank") <= k * page)).select("query_id", "doc_id", "score", "rank")


RANKERS = {"bm25": bm25, "vsm": vsm, "semantic": tfidf_cosine}


def rank_each(models: Sequence[str], index: Index, terms: DataFrame, k: int) -> dict[str, DataFrame]:
    """The rankings by several of RANKERS, kept; without a stored index their scores are taken in one pass."""
    spark = index.docs.sparkSession
    if k > 0 and (scan := index.scan()):
        rows = keep(spark, scan.scores_by(models, terms, k), "scores")
        return {m: keep(spark, ranked(rows.filter(F.col("model") == m).drop("model"), k), m) for m in models}
    return {m: keep(spark, RANKERS[m](index, terms, k), m) for m in models}


def rank_by(model: str, index: Index, terms: DataFrame, k: int) -> DataFrame:
    """Dispatch by name; an unknown name means vsm."""
    if model == "hybrid":
        pool = pool_size(k)
        return fuse([bm25(index, terms, pool), tfidf_cosine(index, terms, pool)], k)
    return RANKERS.get(model, vsm)(index, terms, k)
