"""Command line: python -m tarn index|search|topics|suggest|similar|show|stats|map|evaluate|serve --docs PATH ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import service
from tarn.engine import MODELS, Engine
from tarn.functions.stemming import STEMMERS
from tarn.functions.text import STOPWORDS
from tarn.operators import evaluation
from tarn.operators.index import Index
from tarn.sources import articles as readers
from tarn.sources import sinks


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of .nxml files, or Parquet with doc_id and text."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return readers.as_documents(readers.articles(spark, path)).withColumn("doc_id", F.regexp_replace("doc_id", r"\.nxml$", ""))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tarn")
    p.add_argument("action", choices=["index", "search", "topics", "suggest", "similar", "show", "stats", "map", "evaluate", "serve"])
    p.add_argument("--docs", required=True, help="folder of .nxml files, or a .parquet of doc_id and text")
    p.add_argument("--index", help="folder of a saved index")
    p.add_argument("--no-latent", action="store_true", help="index: leave the latent model out")
    p.add_argument("--stemmer", default="light", choices=sorted(STEMMERS))
    p.add_argument("--stopwords", action="append", help="file of stop words, a word per line; may be given several times")
    p.add_argument("--query", help="search: one query; without it, queries are read line by line")
    p.add_argument("--model", default=None, help="search: one of the models; evaluate: one, several by comma, both, or all")
    p.add_argument("--topk", type=int, default=10)
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--type", default=None, help="all, or diagnosis, test or treatment; topics have their own unless it is given")
    p.add_argument("--expand", action="store_true")
    p.add_argument("--snippet", action="store_true")
    p.add_argument("--csv", help="search: write the results there")
    p.add_argument("--topics")
    p.add_argument("--field", default="summary", choices=["summary", "description"])
    p.add_argument("--output", help="evaluate: folder for run, judgments, table and curves")
    p.add_argument("--port", type=int, default=8080)
    return p.parse_args(argv)


def engine_of(spark: SparkSession, a: argparse.Namespace) -> Engine:
    words = sorted({w for path in a.stopwords for w in readers.stopwords(spark, path)}) if a.stopwords else STOPWORDS
    docs, stem = documents(spark, a.docs), STEMMERS[a.stemmer]
    if a.index and readers.exists(spark, f"{a.index}/postings"):
        return Engine.load(spark, docs, a.index, stopwords=words, stem=stem)
    return Engine(spark, Index(docs, words, stem))


def show(engine: Engine, a: argparse.Namespace, query: str, snippet: bool, expand: bool) -> None:
    kind = a.type or "all"
    print(f"mode: {engine.mode(query)}")
    hits = engine.hits(query, marked=False, model=a.model or "bm25", k=a.topk, kind=kind, expand=expand, page=a.page)
    if a.csv:
        sinks.write_csv(sinks.result_rows(hits).coalesce(1), a.csv)
    columns = ["rank", "doc_id", "score", "type", *["snippet"] * snippet]
    hits.select(*columns).orderBy("rank").show(a.topk, False)


def converse(engine: Engine, a: argparse.Namespace, lines: Iterable[str]) -> None:
    """Queries line by line: `:` before one shows snippets, `+` expands it, `exit` ends."""
    for line in lines:
        query = line.strip()
        if query == "exit":
            return
        snippet, expand = a.snippet, a.expand
        while query[:1] in (":", "+"):
            snippet, expand, query = snippet or query[0] == ":", expand or query[0] == "+", query[1:].strip()
        if query:
            show(engine, a, query, snippet, expand)


def topics_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = readers.topics(spark, a.topics).select(F.col("number").alias("query_id"), F.col(a.field).alias("text"), "type")
    return found if a.type is None else found.withColumn("type", F.lit(a.type))


def batch(engine: Engine, a: argparse.Namespace) -> DataFrame:
    """All topics in one run: (query_id, rank, doc_id, score), of each topic's type."""
    topics = topics_of(engine.spark, a)
    return engine.run(topics, [a.model or "bm25"], a.topk).drop("model")


def evaluate(engine: Engine, a: argparse.Namespace) -> DataFrame:
    """Judged topics under the models; `all` trains the weights first.  With --output all results are written there."""
    spark, topics, qrels = engine.spark, topics_of(engine.spark, a), readers.judgments(engine.spark, a.docs)
    asked = a.model or "both"
    models = ["vsm", "bm25"] if asked == "both" else list(MODELS) if asked == "all" else asked.lower().split(",")
    judged = topics.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    if asked == "all":
        weights = engine.train(judged, qrels)
        if a.index:
            sinks.write_weights(spark, weights, f"{a.index}/weights")
    run = engine.run(judged, models, a.topk)
    measured = evaluation.metrics(run, qrels, models)
    if a.output:
        sinks.write_text(sinks.run_lines(run.orderBy("model", "query_id", "rank")).coalesce(1), f"{a.output}/run")
        sinks.write_text(sinks.qrels_lines(qrels.orderBy("query_id", "doc_id")).coalesce(1), f"{a.output}/judgments")
        sinks.write_csv(sinks.metric_rows(measured, judged).orderBy("model", "topic").coalesce(1), f"{a.output}/metrics", "\t")
        sinks.write_text(sinks.curve_json(run, qrels, models).coalesce(1), f"{a.output}/curves")
    sinks.metric_rows(measured, judged).orderBy("model", "topic").show(1000, False)
    if len(models) > 1:
        evaluation.comparison(run, qrels, models).show(50, False)
    return measured


def main(argv: list[str] | None = None, lines: Iterable[str] = sys.stdin) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("tarn").getOrCreate()
    if a.action == "index":
        engine_of(spark, argparse.Namespace(**{**vars(a), "index": None})).save(a.index, latent=not a.no_latent)
        return
    engine = engine_of(spark, a)
    if a.action == "search" and a.query is None:
        converse(engine, a, lines)
    elif a.action == "search":
        show(engine, a, a.query, a.snippet, a.expand)
    elif a.action == "topics":
        batch(engine, a).orderBy("query_id", "rank").show(10_000, False)
    elif a.action == "suggest":
        engine.suggest(a.query).show(truncate=False)
    elif a.action == "similar":
        engine.similar([service._as_id(engine, a.query)], a.topk).orderBy("rank").show(a.topk, False)
    elif a.action == "show":
        engine.document(service._as_id(engine, a.query)).show(1, False, True)
    elif a.action == "stats":
        engine.stats().show(truncate=False)
    elif a.action == "map":
        print(service.respond(engine, "/map")[1])
    elif a.action == "evaluate":
        evaluate(engine, a)
    else:
        curve = "".join(r.value for r in spark.read.text(f"{a.output}/curves").collect()) if a.output and readers.exists(spark, f"{a.output}/curves") else None
        service.serve(engine, a.port, curve)


if __name__ == "__main__":
    main()
