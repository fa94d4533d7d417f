"""The boolean language: AND OR NOT, parentheses, "phrases", "proximity"~N and prefix* words.

A query is parsed on the driver to a small tree.  Each leaf becomes one set of documents; the tree becomes
one boolean expression over flags, so a query of any shape is a single aggregation by document, with a left
join to all documents for NOT.  An index word that is no stop word stands for its stem; a stop word is left
out of AND and OR, NOT of it is everything; a phrase of nothing but stop words is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.stemming import Stemmer, light_stem
from tarn.functions.text import STOPWORDS
from tarn.operators.index import Index
from tarn.operators.positional import near, phrase_matches
from tarn.operators.rankers import bm25, ranked, vsm
from tarn.operators.vocabulary import wildcard_stems

TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)(?:"|$)(?:\s*~(\d+))?|([^\s()"]+))')


def is_advanced(query: str | None) -> bool:
    """Whether a query is in the language: spaced upper-case operators, a parenthesis, a star, or proximity."""
    if not query:
        return False
    return bool(re.search(r" (AND|OR|NOT) ", f" {query} ") or re.search(r"[(*]", query) or re.search(r'"[^"]+"\s*~\d+', query))


@dataclass
class Node:
    kind: str  # all, none, empty, stem, prefix, phrase, near, and, or, not
    value: object = None
    window: int = 0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]


def analyse(text: str, stopwords=STOPWORDS, stem: Stemmer = light_stem) -> list[str]:
    """The stems of a text's index words in order, as the index would see them."""
    found = re.split(r"\s+", "".join(c if c.isalpha() or c.isdecimal() or c == " " else " " for c in text.lower()))
    return [stem.word(w) for w in found if w and not re.fullmatch("[0-9]+", w) and w not in stopwords]


class Parser:
    """Recursive descent; NOT binds most, then AND, also between neighbours, then OR."""

    def __init__(self, query: str, stopwords=STOPWORDS, stem: Stemmer = light_stem):
        self.stopwords, self.stem, self.tokens, self.at = set(stopwords), stem, [], 0
        for left, right, phrase, window, word in TOKEN.findall(query):
            if left or right:
                self.tokens.append((left or right, None, 0))
            elif word:
                name = word.upper()
                self.tokens.append((name if name in ("AND", "OR", "NOT") else "WORD", word, 0))
            elif phrase or window:
                self.tokens.append(("NEAR" if window else "PHRASE", phrase, int(window or 0)))

    def mode(self) -> str:
        names = []
        for kind, value, _ in self.tokens:
            name = {"AND": "boolean", "OR": "boolean", "NOT": "boolean", "NEAR": "proximity", "PHRASE": "phrase"}.get(kind)
            if kind == "WORD" and value.endswith("*"):
                name = "wildcard"
            if name and name not in names:
                names.append(name)
        return "+".join(names) or "simple"

    def parse(self) -> Node:
        return self._or() if self.tokens else Node("empty")

    def _peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def _join(self, kind: str, parts: list[Node]) -> Node:
        parts = [p for p in parts if p.kind != "empty"]
        return Node("empty") if not parts else parts[0] if len(parts) == 1 else Node(kind, children=parts)

    def _or(self) -> Node:
        parts = [self._and()]
        while self._peek() == "OR":
            self.at += 1
            parts.append(self._and())
        return self._join("or", parts)

    def _and(self) -> Node:
        parts = [self._not()]
        while self._peek() not in (None, "OR", ")"):
            if self._peek() == "AND":
                self.at += 1
            parts.append(self._not())
        return self._join("and", parts)

    def _not(self) -> Node:
        if self._peek() == "NOT":
            self.at += 1
            inner = self._not()
            return Node("all") if inner.kind == "empty" else Node("not", children=[inner])
        return self._atom()

    def _atom(self) -> Node:
        kind = self._peek()
        if kind is None or kind in ("AND", "OR", ")"):
            return Node("empty")
        _, value, window = self.tokens[self.at]
        self.at += 1
        if kind == "(":
            inner = self._or()
            if self._peek() == ")":
                self.at += 1
            return inner
        if kind in ("PHRASE", "NEAR"):
            stems = analyse(value, self.stopwords, self.stem)
            return Node("none") if not stems else Node("near" if kind == "NEAR" else "phrase", stems, window)
        if value.endswith("*") and len(value) > 1:
            return Node("prefix", value[:-1].lower())
        stems = analyse(value, self.stopwords, self.stem)
        return Node("stem", stems[0]) if stems else Node("empty")


def _leaf_sets(spark: SparkSession, index: Index, leaves: list[Node]) -> DataFrame:
    """(leaf, doc_id) for all leaves."""
    by = {kind: [(i, x) for i, x in enumerate(leaves) if x.kind == kind] for kind in ("stem", "prefix", "phrase", "near")}
    sets = index.docs.select(F.lit(0).alias("leaf"), "doc_id").limit(0)  # ids are of the type that the documents have
    if by["stem"]:
        rows = spark.createDataFrame([(i, x.value) for i, x in by["stem"]], "leaf int, stem string")
        found = index.frequencies([x.value for _, x in by["stem"]]).select("stem", "doc_id").distinct()
        sets = sets.unionByName(found.join(rows, "stem").select("leaf", "doc_id"))
    for i, x in by["prefix"]:
        found = index.frequencies(wildcard_stems(index.vocabulary(), x.value))
        sets = sets.unionByName(found.select(F.lit(i).alias("leaf"), "doc_id").distinct())
    if by["phrase"]:
        rows = spark.createDataFrame([(i, x.value) for i, x in by["phrase"]], "query_id int, stems array<string>")
        sets = sets.unionByName(phrase_matches(index, rows).select(F.col("query_id").alias("leaf"), "doc_id"))
    if by["near"]:
        rows = spark.createDataFrame([(i, x.value, x.window) for i, x in by["near"]], "query_id int, stems array<string>, window int")
        sets = sets.unionByName(near(index, rows).select(F.col("query_id").alias("leaf"), "doc_id"))
    return sets


def without(node: Node) -> bool:
    """Whether a document that no leaf matches satisfies a tree."""
    if node.kind in ("all", "not"):
        return node.kind == "all" or not without(node.children[0])
    return bool(node.children) and (all if node.kind == "and" else any)(map(without, node.children))


def matching(index: Index, tree: Node) -> DataFrame:
    """(doc_id) of the documents that satisfy a tree."""
    spark, everything = index.docs.sparkSession, index.docs.select("doc_id").distinct()
    if tree.kind in ("empty", "none"):
        return everything.limit(0)
    if tree.kind == "all":
        return everything
    leaves = tree.leaves()
    place = {id(x): i for i, x in enumerate(leaves)}
    flags = _leaf_sets(spark, index, leaves).groupBy("doc_id").agg(F.collect_set("leaf").alias("hits"))
    if without(tree):
        flags = everything.join(flags, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))

    def condition(node: Node) -> Column:
        if node.kind == "all":
            return F.lit(True)
        if node.kind == "none":
            return F.lit(False)
        if node.kind == "not":
            return ~condition(node.children[0])
        if node.children:
            out = condition(node.children[0])
            for child in node.children[1:]:
                out = out & condition(child) if node.kind == "and" else out | condition(child)
            return out
        return F.array_contains("hits", place[id(node)])

    return flags.filter(condition(tree)).select("doc_id")


def positive_leaves(tree: Node) -> list[Node]:
    """Every leaf that is not below a NOT."""
    return [] if tree.kind == "not" else [x for c in tree.children for x in positive_leaves(c)] if tree.children else [tree]


def positive_terms(index: Index, tree: Node) -> DataFrame:
    """(query_id 0, stem, qtf): what a match is ranked by; a prefix gives the stems of its words, however many."""
    leaves = positive_leaves(tree)
    named = [s for x in leaves for s in ([x.value] if x.kind == "stem" else x.value if x.kind in ("phrase", "near") else [])]
    rows = index.docs.sparkSession.createDataFrame([(s,) for s in named], "stem string")
    for x in leaves:
        if x.kind == "prefix":
            rows = rows.unionByName(wildcard_stems(index.vocabulary(), x.value))
    return rows.groupBy(F.lit(0).alias("query_id"), "stem").agg(F.count("*").alias("qtf"))


def boolean_search(index: Index, query: str, model: str = "bm25", k: int | None = 10) -> DataFrame:
    """(query_id 0, doc_id, score, rank): matching documents ranked by BM25, or VSM for any other model."""
    tree = Parser(query, index.stopwords, index.stem).parse()
    allowed = matching(index, tree)
    if not any(x.kind in ("stem", "prefix", "phrase", "near") for x in positive_leaves(tree)):
        return ranked(allowed.select(F.lit(0).alias("query_id"), "doc_id", F.lit(1.0).alias("score")), k)
    scored = (bm25 if model == "bm25" else vsm)(index, positive_terms(index, tree), None)
    return ranked(scored.drop("rank").join(allowed, "doc_id", "left_semi").select("query_id", "doc_id", "score"), k)
