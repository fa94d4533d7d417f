"""The search engine as one object: what a command line, a server or a notebook calls."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import highlighted_snippet, snippet
from tarn.operators import evaluation, feedback, ltr, rankers, vectors, vocabulary
from tarn.operators.index import Index
from tarn.operators.positional import combined_search, phrase_matches, phrase_search
from tarn.operators.store import keep
from tarn.plans.boolean import Parser, analyse, boolean_search, is_advanced
from tarn.sources import articles, sinks

MODELS = ("vsm", "bm25", "semantic", "hybrid", "ltr")
#: Results that a type filter chooses from, for each that is wanted.
OVERFETCH = 20


def extract_phrases(query: str, index: Index) -> tuple[str, list[list[str]]]:
    """The text without quoted spans, and their stems where there is more than one."""
    phrases = [analyse(p, index.stopwords, index.stem) for p in re.findall(r'"([^"]+)"', query)]
    return re.sub(r'"[^"]+"', " ", query), [p for p in phrases if len(p) > 1]


class Engine:
    """An index, and a latent model and ranking weights where there are any."""

    def __init__(self, spark: SparkSession, index: Index, latent: tuple[DataFrame, DataFrame] | None = None, weights: list[float] | None = None):
        self.spark, self.index, self.latent, self.weights = spark, index, latent, weights

    @classmethod
    def load(cls, spark: SparkSession, docs: DataFrame, path: str, **how) -> Engine:
        """The engine in a folder that save() wrote; a latent model or weights that are missing are left out."""
        return cls(spark, Index.load(docs, path, **how), articles.latent(spark, f"{path}/latent"), articles.weights(spark, f"{path}/weights"))

    def save(self, path: str, latent: bool = False) -> Engine:
        """Write the index and what belongs to it; latent: build that model too, unless there are fewer than two documents."""
        index = self.index.save(path)
        if latent and self.latent is None and index.docs.limit(2).count() == 2:
            self.latent = vectors.lsa(self.spark, index)
        if self.latent is not None:
            sinks.write_latent(*self.latent, f"{path}/latent")
        if self.weights is not None:
            sinks.write_weights(self.spark, self.weights, f"{path}/weights")
        return Engine(self.spark, index, articles.latent(self.spark, f"{path}/latent"), self.weights)

    # ---- ranking ------------------------------------------------------------------------------------------

    def terms(self, queries: DataFrame, expand: bool = False) -> DataFrame:
        found = rankers.query_terms(self.index, queries)
        return feedback.expand(self.index, found, head=self._head()) if expand else found

    def _head(self) -> str:
        return "head" if "head" in self.index.docs.columns else "text"

    def _types(self) -> DataFrame | None:
        return self.index.docs.select("doc_id", "type") if "type" in self.index.docs.columns else None

    def semantic(self, terms: DataFrame, k: int | None) -> DataFrame:
        if self.latent is None:
            return rankers.tfidf_cosine(self.index, terms, k)
        documents, stems = self.latent
        return vectors.cosine_topk(documents, vectors.project(terms, stems), k)

    def rank(self, terms: DataFrame, model: str, k: int) -> DataFrame:
        """A batch of queries by one model; lexical models put near known stems for unknown ones."""
        return Rankings(self, terms).by(model, k)

    def features(self, terms: DataFrame, pool: int) -> DataFrame:
        return Rankings(self, terms).features(pool)

    def search(self, query: str, model: str = "bm25", k: int = 10, kind: str | None = "all", expand: bool = False, page: int = 1) -> DataFrame:
        """One query, plain, with quoted phrases, or in the boolean language: (query_id 0, doc_id, score, rank).

        page: the results from (page - 1) * k + 1 to page * k.
        """
        if k < 1 or page < 1:
            raise ValueError("k and page are 1 or more")
        fetch = k * page if kind is None or kind.lower() == "all" else OVERFETCH * k * page
        if is_advanced(query) and not expand:
            found = boolean_search(self.index, query, model, fetch)
        else:
            rest, phrases = extract_phrases(query, self.index)
            one = self.spark.createDataFrame([(0, rest)], "query_id int, text string")
            terms, bare = self.terms(one, expand), not analyse(rest, self.index.stopwords, self.index.stem)
            rows = self.spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "query_id int, stems array<string>")
            if phrases and bare:
                found = rankers.ranked(phrase_search(self.index, rows, fetch).select(F.lit(0).alias("query_id"), "doc_id", "score"), fetch)
            elif phrases:
                every = phrase_matches(self.index, rows).groupBy("doc_id").agg(F.count_distinct("query_id").alias("n")).filter(F.col("n") == len(phrases))
                found = combined_search(self.rank(terms, model, 5 * fetch), every.select(F.lit(0).alias("query_id"), "doc_id")).filter(F.col("rank") <= fetch)
            else:
                found = self.rank(terms, model, fetch)
        types = self._types()
        return rankers.filter_type(found, found.select("doc_id") if types is None else types, kind if types is not None else None, k, page)

    def hits(self, query: str, marked: bool = True, **how) -> DataFrame:
        """(rank, doc_id, score, type, snippet) of a search."""
        index = self.index
        stems = list(dict.fromkeys(analyse(query, index.stopwords, index.stem)))
        wanted = F.array(*[F.lit(s) for s in stems]) if stems else F.array().cast("array<string>")
        fields = [F.col(c) for c in ("title", "abstract", "body") if c in index.docs.columns] or [F.col("text")]
        kind = F.coalesce(F.col("type"), F.lit("")) if "type" in index.docs.columns else F.lit("")
        cut = (highlighted_snippet if marked else snippet)(fields, wanted, index.stem)
        return self.search(query, **how).join(index.docs, "doc_id").select("rank", "doc_id", "score", kind.alias("type"), cut.alias("snippet"))

    def search_response(self, query: str, model: str = "bm25", k: int = 10, kind: str = "all", expand: bool = False, page: int = 1, timed: bool = True) -> DataFrame:
        """One row (value): the JSON of a search, with highlighted snippets; timed: also how long it took."""
        began = time.time()
        query = (query or "").strip()
        if not query:
            raise ValueError("missing query")
        index = self.index
        rest, phrases = extract_phrases(query, index)
        stems = analyse(rest, index.stopwords, index.stem)
        queries = self.spark.createDataFrame([(0, rest)], "query_id int, text string")
        added = [r.stem for r in feedback.rocchio_terms(index, self.terms(queries), head=self._head()).orderBy("place").collect()] if expand and stems else []
        oov: dict[str, list[str]] = {}
        for r in self.unknown(queries).orderBy("stem", "place").collect():  # three at most for each word of the query
            oov.setdefault(r.stem, []).append(r.suggestion)
        hits = keep(self.spark, self.hits(query, model=model, k=k, kind=kind, expand=expand, page=page), "hits")

        def strings(values: list[str]):
            return F.array(*[F.lit(v) for v in values]).cast("array<string>")

        asked = [
            F.lit(query).alias("query"), strings(stems + added).alias("stems"), strings(added).alias("expanded_terms"),
            F.array(*[strings(p) for p in phrases]).cast("array<array<string>>").alias("phrases"), F.lit(model).alias("model"), F.lit(kind).alias("type"),
            F.lit(self.mode(query)).alias("mode"), F.lit(page).alias("page"),
            F.map_from_arrays(strings(list(oov)), F.array(*[strings(v) for v in oov.values()]).cast("array<array<string>>")).alias("oov"),
        ]
        if timed:
            asked.append(F.lit(round(1000 * (time.time() - began))).alias("elapsed_ms"))
        hit = F.struct("rank", "doc_id", F.col("score").cast("decimal(18,6)").alias("score"), "type", "snippet")
        return hits.agg(F.to_json(F.struct(*asked, F.array_sort(F.collect_list(hit)).alias("results"))).alias("value"))

    def mode(self, query: str) -> str:
        return Parser(query, self.index.stopwords, self.index.stem).mode()

    # ---- services -----------------------------------------------------------------------------------------

    def suggest(self, prefix: str, k: int = 8) -> DataFrame:
        return vocabulary.autocomplete(self.index.vocabulary(), prefix, k)

    def unknown(self, queries: DataFrame) -> DataFrame:
        """Suggestions for stems that no document has."""
        known = self.index.stems().select("stem")
        return vocabulary.suggestions(rankers.query_terms(self.index, queries).select("stem").distinct().join(known, "stem", "left_anti"), known)

    def similar(self, doc_ids: list, k: int = 5) -> DataFrame:
        kind = dict(self.index.docs.dtypes)["doc_id"]
        return feedback.similar(self.index, self.spark.createDataFrame([(d,) for d in doc_ids], f"doc_id {kind}"), k, self._head())

    def document(self, doc_id) -> DataFrame:
        """The document with this id, all its fields."""
        return self.index.docs.filter(F.col("doc_id") == doc_id)

    def documents_of(self, results: DataFrame) -> DataFrame:
        """The documents of a result list with all their fields, beside query_id, score and rank."""
        return results.join(self.index.docs, "doc_id")

    def stats(self, top: int = 12) -> DataFrame:
        """One row: size of the vocabulary, documents, mean length, and the words that most documents have."""
        words = self.index.vocabulary()
        best = words.orderBy(F.desc("df"), "word").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("o"), "word"))).alias("t"))
        return words.agg(F.count("*").alias("vocabulary")).crossJoin(self.index.statistics()).crossJoin(best.select(F.transform("t", lambda x: F.struct(x["word"].alias("word"), (-x["o"]).alias("df"))).alias("top")))

    def document_map(self, clusters: int = 4, rounds: int = 30, keywords: int = 4) -> tuple[DataFrame, DataFrame]:
        """Points (doc_id, x, y, type, cluster), 2 to 8 clusters, and each cluster's keywords; a latent model is built if there is none."""
        if self.latent is None:
            documents, stems = vectors.lsa(self.spark, self.index)
            self.latent = keep(self.spark, documents, "latent-documents"), keep(self.spark, stems, "latent-stems")
        documents, stems = self.latent
        assigned, centroids = vectors.kmeans(documents, max(2, min(8, clusters)), rounds)
        points = vectors.map2d(documents).join(assigned.select("doc_id", "cluster"), "doc_id")
        types = self._types()
        points = points.withColumn("type", F.lit("")) if types is None else points.join(types, "doc_id", "left")
        return points, vectors.cluster_keywords(stems, centroids, keywords)

    def health(self) -> dict:
        """Counts and which models there are."""
        terms, docs = self.index.vocabulary().count(), self.index.statistics().first().n_docs
        dims = len(self.latent[1].first().v) if self.latent is not None else 0
        return {"status": "ok", "terms": terms, "docs": docs, "semantic": self.latent is not None, "latent_dims": dims, "ltr": self.weights is not None, "models": list(MODELS)}

    # ---- evaluation ---------------------------------------------------------------------------------------

    def run(self, queries: DataFrame, models: Sequence[str] = ("bm25", "vsm"), k: int = 10) -> DataFrame:
        """A batch of topics (query_id, text, and type where they have one) under several models: (model, query_id, doc_id, score, rank).

        Every model is asked for 20 k documents, of which those of the topic's type stay, and k of these.  A
        ranking that several models need is made once.
        """
        rankings, types, out = Rankings(self, self.terms(queries), keep_for=OVERFETCH * k), self._types(), None
        wanted = queries.select("query_id", "type") if types is not None and "type" in queries.columns else None
        for model in models:
            found = rankings.by(model, OVERFETCH * k)
            part = rankers.filter_type(found, found.select("doc_id") if types is None else types, wanted, k)
            part = part.select(F.lit(model).alias("model"), "query_id", "doc_id", "score", "rank")
            out = part if out is None else out.unionByName(part)
        return keep(self.spark, out, "run")

    def evaluate(self, queries: DataFrame, qrels: DataFrame, models: Sequence[str] = ("bm25", "vsm"), k: int = 10) -> DataFrame:
        judged = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
        return evaluation.metrics(self.run(judged, models, k), qrels, models)

    def train(self, queries: DataFrame, qrels: DataFrame) -> list[float]:
        data = ltr.training_data(self.features(self.terms(queries), 50), qrels)
        self.weights = ltr.best_weights(ltr.train(self.spark, data))
        return self.weights


class Rankings:
    """The rankings of one batch of queries.

    keep_for: results per query that models will be asked for; the three basic rankings are then made once, as
    long as the longest pool needs, and kept.
    """

    def __init__(self, engine: Engine, terms: DataFrame, keep_for: int | None = None):
        self.engine, self.terms, self.most = engine, terms, None
        if keep_for:
            self.terms = keep(engine.spark, terms, "terms")
            self.most = max(rankers.pool_size(keep_for), rankers.pool_size(keep_for, "ltr"))
        self.lexical = rankers.substitute_unknown(engine.index, self.terms)
        self.made: dict[str, DataFrame] = {}

    def _basic(self, model: str, k: int) -> DataFrame:
        rank = {
            "bm25": lambda n: rankers.bm25(self.engine.index, self.lexical, n),
            "vsm": lambda n: rankers.vsm(self.engine.index, self.lexical, n),
            "semantic": lambda n: self.engine.semantic(self.terms, n),
        }[model]
        if self.most is None:
            return rank(k)
        if model not in self.made:
            self.made[model] = keep(self.engine.spark, rank(self.most), model)
        return self.made[model].filter(F.col("rank") <= k)

    def features(self, pool: int) -> DataFrame:
        return rankers.features(self._basic("bm25", pool), self._basic("vsm", pool), self._basic("semantic", pool))

    def by(self, model: str, k: int) -> DataFrame:
        """An unknown model is vsm; ltr without weights is bm25."""
        if model == "ltr" and self.engine.weights is not None:
            return rankers.linear(self.features(rankers.pool_size(k, "ltr")), self.engine.weights, k)
        if model == "hybrid":
            pool = rankers.pool_size(k)
            return rankers.fuse([self._basic("bm25", pool), self._basic("semantic", pool)], k)
        return self._basic({"ltr": "bm25", "bm25": "bm25", "semantic": "semantic"}.get(model, "vsm"), k)
