"""Micro-fixtures for analysis, index, rankers, the boolean language, feedback, evaluation and vectors."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import __main__ as command
from tarn import service
from tarn.engine import MODELS, Engine, extract_phrases
from tarn.functions import text as T
from tarn.functions.stemming import identity_stem, porter_stem
from tarn.operators import evaluation, feedback, ltr, rankers, store, vectors, vocabulary
from tarn.operators.index import Index
from tarn.operators.positional import combined_search, near, phrase_matches, spans
from tarn.plans.boolean import Parser, boolean_search, is_advanced, matching
from tarn.sources import articles, sinks

DOCS = [
    (1, "The heart of 12 patients", "test"), (2, "chest pain with shortness of breath", "diagnosis"), (3, "pain chest heart", "diagnosis"),
    (4, "walker walks walking", "treatment"), (5, "walk heart chest pain pain", "treatment"), (6, "", "test"), (7, None, "test"), (8, "a1x 2nd chest x y z pain", "diagnosis"),
]


@pytest.fixture(scope="module")
def index(spark):
    return Index(spark.createDataFrame(DOCS, "doc_id long, text string, type string").cache())


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def terms(spark, *queries):
    return spark.createDataFrame([(q, s, n) for q, s, n in queries], "query_id int, stem string, qtf long")


def test_positions_and_lengths(index):
    got = {(r.word, r.pos) for r in index.tokens().filter("doc_id = 1").collect()}
    assert got == {("heart", 2), ("patients", 5)}
    assert [r.word for r in index.tokens().filter("doc_id = 8 and pos < 3").orderBy("pos").collect()] == ["a1x", "2nd"]
    lengths = {r.doc_id: r.dl for r in index.lengths().collect()}
    assert lengths == {1: 5, 2: 6, 3: 3, 4: 3, 5: 5, 6: 0, 7: 0, 8: 7}
    stats = index.statistics().first()
    assert stats.n_docs == 8 and stats.avgdl == pytest.approx(29 / 8)
    assert {r.doc_id: round(r.norm, 6) for r in index.norms().collect()}[6] == 0


def test_index_saved_and_loaded(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = Index.load(index.docs, str(tmp_path))
    q = terms(spark, (0, "heart", 1), (0, "pain", 2))
    for ranker in (rankers.bm25, rankers.vsm):
        assert ranker(again, q, 5).collect() == ranker(index, q, 5).collect()


def test_bm25_and_vsm(spark, index):
    n, df, avgdl = 8, 4, 29 / 8
    score = {r.doc_id: r.score for r in rankers.bm25(index, terms(spark, (0, "pain", 1)), None).collect()}
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 5 / avgdl))
    assert score[5] == pytest.approx(want, abs=1e-6) and set(score) == {2, 3, 5, 8}
    one, two = terms(spark, (0, "pain", 1)), terms(spark, (0, "pain", 2))
    assert rankers.bm25(index, one).collect() == rankers.bm25(index, two).collect()
    single = {r.doc_id: r.score for r in rankers.vsm(index, one).collect()}
    assert all(r.score == pytest.approx(2 * single[r.doc_id], abs=2e-6) for r in rankers.vsm(index, two).collect())
    with pytest.raises(ValueError):
        rankers.bm25(index, one, 0)


def test_each_word_of_a_stem_counts(spark, index):
    score = rankers.bm25(index, terms(spark, (0, "walk", 1)), None).filter("doc_id = 4").first().score
    assert score > 0 and index.frequencies().filter("doc_id = 4 and stem = 'walk'").count() == 2


def test_fusion_and_features(spark, index):
    lists = [spark.createDataFrame([(0, d, 1.0 / r, r) for r, d in enumerate(x, 1)], "query_id int, doc_id long, score double, rank int") for x in ([1, 2, 3], [1, 4, 5])]
    top = rankers.fuse(lists).first()
    assert top.doc_id == 1 and top.score == pytest.approx(2 / 61, abs=1e-6)
    f = {r.doc_id: r for r in rankers.features(lists[0], lists[1], lists[1]).collect()}
    assert (f[1].f0, f[1].f1, f[1].f2, f[1].f3, f[1].f4) == (1.0, 1.0, 1.0, 1.0, 1.0) and f[4].f0 == 0 and f[4].f4 == 0.5


def test_type_filter_stays_above_the_limit(spark):
    run = spark.createDataFrame([(0, d, 1.0 / d, d) for d in range(1, 60)], "query_id int, doc_id long, score double, rank int")
    types = spark.createDataFrame([(d, "x" if d > 38 else "y") for d in range(1, 60)], "doc_id long, type string")
    assert [(r.doc_id, r["rank"]) for r in rankers.filter_type(run, types, "X", 2).orderBy("rank").collect()] == [(39, 1), (40, 2)]
    assert rankers.filter_type(run, types, "x", 1).count() == 0 and rankers.filter_type(run, types, None, 3).count() == 3


def test_phrases_and_proximity(spark, index):
    phrases = spark.createDataFrame([(0, ["chest", "pain"]), (1, ["shortness", "breath"]), (2, ["pain", "pain"])], "query_id int, stems array<string>")
    assert sorted((r.query_id, r.doc_id, r.score) for r in phrase_matches(index, phrases).collect()) == [(0, 2, 1.0), (0, 5, 1.0), (2, 5, 1.0)]
    groups = spark.createDataFrame([(0, ["chest", "pain"], 1), (1, ["pain", "pain"], 0), (2, ["chest", "pain", "heart"], 2)], "query_id int, stems array<string>, window int")
    assert sorted((r.query_id, r.doc_id) for r in near(index, groups).collect()) == [(0, 2), (0, 3), (0, 5), (1, 2), (1, 3), (1, 5), (1, 8), (2, 3), (2, 5)]
    assert {r.doc_id: r.span for r in spans(index, groups.filter("query_id = 0")).collect()} == {2: 1, 3: 1, 5: 1, 8: 4}
    base = spark.createDataFrame([(0, 2, 2.0, 1), (0, 3, 1.0, 2), (1, 3, 1.0, 1)], "query_id int, doc_id long, score double, rank int")
    hits = spark.createDataFrame([(0, 3)], "query_id int, doc_id long")
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in combined_search(base, hits).collect()) == [(0, 3, 1), (1, 3, 1)]


@pytest.mark.parametrize(
    "query,want",
    [
        ("heart AND pain", [3, 5]), ("heart pain", [3, 5]), ("heart OR walk", [1, 3, 4, 5]), ("NOT pain", [1, 4, 6, 7]), ("the AND heart", [1, 3, 5]), ('"the of" AND heart', []),
        ("NOT the", [1, 2, 3, 4, 5, 6, 7, 8]), ("walk*", [4, 5]), ('"chest pain"', [2, 5]), ('"pain heart"~1', []), ('"pain chest"~4', [2, 3, 5, 8]), ("(heart OR breath) AND NOT walk", [1, 2, 3]),
        ("heart) pain", [1, 3, 5]), ("NOT NOT heart", [1, 3, 5]), ("", []), ("heart and chest or breath", [2, 3, 5]),
    ],
)
def test_boolean(index, query, want):
    assert ids(matching(index, Parser(query).parse())) == want


def test_boolean_ranking_and_modes(index):
    assert is_advanced("a AND b") and is_advanced("(a)") and is_advanced('"a b" ~3') and not is_advanced("a and b") and not is_advanced('"a b"') and not is_advanced(None)
    assert Parser('a AND "b c" walk* "x y"~2').mode() == "boolean+phrase+wildcard+proximity" and Parser("a b").mode() == "simple"
    got = boolean_search(index, "heart AND NOT walk", "bm25").collect()
    assert {r.doc_id for r in got} == {1, 3} and [r["rank"] for r in sorted(got, key=lambda r: -r.score)] == [1, 2]
    assert {r.score for r in boolean_search(index, "NOT pain", "vsm").collect()} == {1.0}


def test_boolean_on_names_and_other_stems(spark):
    docs = spark.createDataFrame([(f"PMC{i}", t) for i, t, _ in DOCS], "doc_id string, text string")
    plain = Index(docs, stem=identity_stem)
    assert ids(matching(plain, Parser("heart AND pain", stem=identity_stem).parse())) == ["PMC3", "PMC5"]
    assert ids(boolean_search(plain, "walk*")) == ["PMC4", "PMC5"] and ids(boolean_search(plain, "walking AND NOT pain")) == ["PMC4"]
    assert ids(boolean_search(plain, '"chest pain" OR walks')) == ["PMC2", "PMC4", "PMC5"]
    assert ids(Engine(spark, plain).search("walking")) == ["PMC4"] and ids(Engine(spark, Index(docs)).search("walking")) == ["PMC4", "PMC5"]
    own = Index(docs, stem=lambda w: F.substring(w, 1, 4))
    assert own.stem.word("walker") == "walk" and ids(boolean_search(own, "walker")) == ["PMC4", "PMC5"]
    porter = Engine(spark, Index(docs, stem=porter_stem))
    assert ids(porter.search("walked")) == ["PMC4", "PMC5"]
    assert "<mark>walking</mark>" in " ".join(r.snippet for r in porter.hits("walks").collect())


@pytest.mark.parametrize("word,stem", [x.split() for x in "caresses caress,ponies poni,agreed agre,plastered plaster,hopping hop,filing file,happy happi,sky sky,relational relat,vietnamization vietnam,electrical electr,adjustment adjust,adoption adopt,effective effect,probate probat,controll control,x2 x2,is is".split(",")])
def test_porter(word, stem):
    assert porter_stem.word(word) == stem


def test_vocabulary(spark, index):
    assert [(r.word, r.df) for r in vocabulary.autocomplete(index.vocabulary(), "CH").collect()] == [("chest", 4)]
    assert vocabulary.autocomplete(index.vocabulary(), "c").count() == 0
    known = spark.createDataFrame([("heart",), ("hearty",), ("heat",), ("heap",), ("pain",)], "stem string")
    got = vocabulary.suggestions(spark.createDataFrame([("heert",), ("heartx",), ("he",)], "stem string"), known).orderBy("stem", "place").collect()
    assert [(r.stem, r.suggestion) for r in got] == [("heartx", "heart"), ("heartx", "hearty"), ("heartx", "heat")]
    e = Engine(spark, index)
    near_ = e.rank(terms(spark, (0, "hearx", 1)), "bm25", 5)
    assert ids(near_) == [1, 3, 5] and e.semantic(terms(spark, (0, "hearx", 1)), 5).count() == 0


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(T.html_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(T.pmcid_of(F.lit("/a/b/33.nxml"))) == "33" and one(T.type_of(F.lit("/a/Diagnosis/3"))) == "diagnosis" and one(T.type_of(F.lit("/a/b"))) == ""
    stems = F.array(F.lit("pain"))
    words = " ".join(f"w{i}" for i in range(20)) + " pain, " + " ".join(f"v{i}" for i in range(20))
    assert one(T.snippet([F.lit("none"), F.lit(words)], stems)) == "..." + " ".join(f"w{i}" for i in range(12, 20)) + " pain, " + " ".join(f"v{i}" for i in range(11)) + " ..."
    assert one(T.snippet([F.lit("nothing"), F.lit(None).cast("string")], stems)) == "(no snippet)"
    assert one(T.highlighted_snippet([F.lit("a <Pain> b")], stems)) == "a <mark>&lt;Pain&gt;</mark> b"
    assert one(T.highlight(F.lit("a  pain\nb"), stems)) == "a  <mark>pain</mark>\nb"
    assert one(F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3 and one(F.levenshtein(F.lit(""), F.lit("abc"))) == 3
    empty = Index(spark.createDataFrame([], "doc_id long, text string"))
    assert extract_phrases('x "pain" y "chest pain"', empty) == ("x   y  ", [["chest", "pain"]])


def test_metrics(spark):
    run = spark.createDataFrame([("m", 1, d, s, r) for r, (d, s) in enumerate([("A", 9.0), ("X", 8.0), ("B", 7.0)], 1)], "model string, query_id int, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([(1, d, 1) for d in "ABC"], "query_id int, doc_id string, rel int")
    m = evaluation.metrics(run, qrels).first()
    assert (m.num_rel, m.num_rel_ret, m.p5) == (3, 2, 0.4) and m.ap == pytest.approx((1 + 2 / 3) / 3, abs=1e-6) and m.rprec == pytest.approx(2 / 3, abs=1e-6)
    c = [r.precision for r in evaluation.curve(run, qrels).orderBy("level").collect()]
    assert len(c) == 11 and c[0] == 1.0 and c[6] == pytest.approx(2 / 3, abs=1e-6) and c[10] == 0


def test_judged_queries_without_results_count(spark):
    run = spark.createDataFrame([("m", 1, "A", 9.0, 1)], "model string, query_id int, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([(1, "A", 1), (2, "B", 2)], "query_id int, doc_id string, rel int")
    got = {(r.model, r.query_id): (r.num_rel, r.num_ret, r.ap) for r in evaluation.metrics(run, qrels, ["m", "silent"]).collect()}
    assert got == {("m", 1): (1, 1, 1.0), ("m", 2): (1, 0, 0.0), ("silent", 1): (1, 0, 0.0), ("silent", 2): (1, 0, 0.0)}
    assert {r.model: (r.n, r.ap) for r in evaluation.means(evaluation.metrics(run, qrels)).collect()} == {"m": (2, 0.5)}
    assert {r.precision for r in evaluation.mean_curve(run, qrels).collect()} == {0.5}
    table = {r.topic: (r.type, r.ap) for r in sinks.metric_rows(evaluation.metrics(run, qrels), spark.createDataFrame([(1, "test")], "query_id int, type string")).collect()}
    assert table == {"1": ("TEST", "1.0000"), "2": ("-", "0.0000"), "MAP/Avg": ("-", "0.5000")}


def test_topic_types_are_applied_after_the_overfetch(spark, index):
    e = Engine(spark, index, weights=[0.4, 0.2, 0.2, 0.1, 0.1])
    topics = spark.createDataFrame([(0, "chest pain", "DIAGNOSIS"), (1, "chest pain", None), (2, "heart", "all"), (3, "nothing known", "test")], "query_id int, text string, type string")
    got = e.run(topics, ("bm25", "vsm", "semantic", "hybrid", "ltr"), 2).collect()
    kinds = {i: k for i, _, k in DOCS}
    assert {kinds[r.doc_id] for r in got if r.query_id == 0} == {"diagnosis"} and all(r["rank"] <= 2 for r in got)
    for model in ("bm25", "vsm", "semantic", "hybrid", "ltr"):
        alone = e.rank(e.terms(topics.filter("query_id = 1")), model, 40).filter("rank <= 2").collect()
        assert sorted((r.doc_id, r.score, r["rank"]) for r in alone) == sorted((r.doc_id, r.score, r["rank"]) for r in got if r.model == model and r.query_id == 1)
    qrels = spark.createDataFrame([(0, 5, 1), (3, 1, 1)], "query_id int, doc_id long, rel int")
    assert {(r.query_id, r.ap) for r in e.evaluate(topics, qrels, ("bm25",), 2).collect()} == {(0, 0.0), (3, 0.0)}


def test_wilcoxon(spark):
    ap = {"VSM": [0.6268, 0.9167, 0.8339, 0.8542, 0.6042, 0.5250], "BM25": [0.5635, 0.4583, 0.5851, 0.5683, 0.5479, 0.5821], "HYB": [0.6979, 0.8542, 0.7228, 0.6679, 0.6042, 0.5655]}
    rows = spark.createDataFrame([(m, i, v) for m, x in ap.items() for i, v in enumerate(x)], "model string, query_id int, ap double")
    got = {(r.model_a, r.model_b): r.p for r in evaluation.wilcoxon(rows).collect()}
    for pair, p in ((("BM25", "VSM"), 0.0747), (("BM25", "HYB"), 0.0464), (("HYB", "VSM"), 0.3452)):
        assert got[pair] == pytest.approx(p, abs=1e-4)


def test_feedback(spark, index):
    q = terms(spark, (0, "breath", 1))
    new = feedback.rocchio_terms(index, q).collect()
    assert new and all(r.stem != "breath" for r in new) and {r.stem for r in feedback.expand(index, q).collect()} == {"breath", *(r.stem for r in new)}
    assert 3 not in ids(feedback.similar(index, spark.createDataFrame([(3,)], "doc_id long")))
    run = rankers.bm25(index, terms(spark, (0, "chest", 1), (0, "pain", 1)), 30)
    picked = feedback.diversify(index, run, 0.5, 3).orderBy("rank").collect()
    assert len(picked) == 3 and picked[0].doc_id == run.orderBy("rank").first().doc_id


def test_vectors(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[1, 0.1], [0.9, 0], [0, 1], [0.1, 0.9], [0, 0]])]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = {r.doc_id: r.cluster for r in vectors.kmeans(v.filter("doc_id < 4"), 2, 10)[0].collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}
    top = vectors.cosine_topk(v, v.filter("doc_id = 0").withColumnRenamed("doc_id", "query_id"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [0, 1] and top[0].score == 1.0
    assert vectors.map2d(v).filter("doc_id = 4").first().x == 0
    assert vectors.cosine_topk(v, v.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_cosines_are_those_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "QUERY_BYTES", limit)  # one block of queries, and several
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((60, 5)), 1)
    x[7] = x[3]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, v array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in vectors.cosine_topk(v, v.filter("doc_id < 9").withColumnRenamed("doc_id", "query_id"), 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(9):
        s = np.round(unit @ unit[q], 6)
        order = sorted((i for i in range(60) if s[i] > 0), key=lambda i: (-s[i], i))[:4]
        assert [got[q, k + 1] for k in range(len(order))] == [(i, pytest.approx(s[i], abs=2e-6)) for i in order]


def test_kmeans_by_hand(spark):
    """Against plain loops, with ids far apart and a cluster that loses all its rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((30, 3)) + [4, 0, 0], rng.standard_normal((30, 3)) + [0, 4, 0]])
    x[45] = x[0] * 2  # a first centroid that ties with an earlier one gets no rows
    names = [i if i < 59 else 10**15 for i in range(60)]
    v = spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, x)], "doc_id long, v array<double>").repartition(4)
    assert np.allclose(vectors.seeds(v, 4), (x / np.linalg.norm(x, axis=1, keepdims=True))[[0, 15, 30, 45]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    start = unit[[0, 15, 30, 45]]
    for rounds in (1, 2, 6):
        c = start
        for _ in range(rounds):
            own = np.argmax(np.round(unit @ c.T, 9), axis=1)
            c = np.array([np.round(s / np.linalg.norm(s), 9) if (s := unit[own == j].sum(axis=0)).any() else start[j] for j in range(4)])
        want = np.argmax(np.round(unit @ c.T, 9), axis=1)
        assigned, centroids = vectors.kmeans(v, 4, rounds)
        got = {r.doc_id: r.cluster for r in assigned.collect()}
        assert [got[n] for n in names] == want.tolist() and np.allclose(centroids, c, atol=1e-8)


@pytest.mark.parametrize("exact", [2048, 0])
def test_latent_full_rank_ranks_as_tfidf(spark, monkeypatch, exact):
    monkeypatch.setattr(vectors, "GRAM_ROWS", exact)
    docs = spark.createDataFrame([(0, "aaa bbb"), (1, "aaa bbb bbb"), (2, "ccc ddd"), (3, "ccc ddd aaa")], "doc_id long, text string")
    index = Index(docs)
    documents, stems = vectors.lsa(spark, index, k=4, passes=6)
    q = terms(spark, (0, "aaa", 1), (1, "ccc", 1))
    latent = {(r.query_id, r.doc_id): r.score for r in vectors.cosine_topk(documents, vectors.project(q, stems), 4).collect()}
    exact = {(r.query_id, r.doc_id): r.score for r in rankers.tfidf_cosine(index, q, 4).collect()}
    for query in (0, 1):
        ratio = [latent[k] / exact[k] for k in exact if k[0] == query]
        assert np.ptp(ratio) < 1e-3


@pytest.mark.parametrize("exact", [2048, 0])
def test_latent_vectors_are_singular_vectors(spark, monkeypatch, exact):
    monkeypatch.setattr(vectors, "GRAM_ROWS", exact)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"qq{'abcdefghij'[x // 10]}{'klmnoprtuv'[x % 10]}" for x in rng.integers(0, 70, 25))) for i in range(60)], "doc_id long, text string")
    index = Index(docs)
    matrix = index.stem_matrix().toPandas().pivot_table(index="doc_id", columns="stem", values="w", fill_value=0.0)
    u, s, vt = np.linalg.svd(matrix.to_numpy().astype(float), full_matrices=False)
    documents, stems = vectors.lsa(spark, index, k=6)
    d = np.array([r.v for r in documents.orderBy("doc_id").collect()])
    v = {r.stem: r.v for r in stems.collect()}
    w = np.array([v[x] for x in matrix.columns])
    assert d.shape == (60, 6) and np.allclose(np.linalg.norm(d, axis=0), s[:6], rtol=1e-4)
    assert np.allclose(np.abs((w * vt[:6].T).sum(axis=0)), 1, atol=1e-2)
    documents, stems = vectors.lsa(spark, index)
    assert len(documents.first().v) == len(stems.first().v) == min(vectors.RANK, *matrix.shape)


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(q, d, int(x[2] > 0.7), *map(float, x)) for q in range(6) for d, x in enumerate(rng.random((20, 5)))]
    data = spark.createDataFrame(rows, "query_id int, doc_id int, label int, f0 double, f1 double, f2 double, f3 double, f4 double")
    trained = ltr.train(spark, data, restarts=2)
    w = ltr.best_weights(trained)
    best = trained.agg(F.max("map")).first()[0]
    assert sum(w) == pytest.approx(1) and best > 0.95 and ltr.pool_map(data, w).first().map == pytest.approx(best, abs=1e-6)


def test_ascent_by_hand():
    rng = np.random.default_rng(4)
    groups = [(rng.random((12, 5)), (rng.random(12) > 0.7).astype(int)) for _ in range(3)]
    w = [0.2] * 5
    for _ in range(40):
        moved = False
        for i in range(5):
            tried = [(w[i], ltr._map(groups, np.array(w)))]
            for step in (0.5, 0.2, 0.1, 0.05, -0.05, -0.1, -0.2, -0.5):
                other = [*w[:i], max(0.0, tried[0][0] + step), *w[i + 1 :]]
                value = ltr._map(groups, np.array(other))
                if value > tried[-1][1] + 1e-6:
                    tried.append((other[i], value))
            moved, w[i] = moved or len(tried) > 1, tried[-1][0]
        if not moved:
            break
    got, _ = ltr.ascend(groups, np.full(5, 0.2))
    assert np.allclose(got, np.array(w) / sum(w))


def test_saved_engine_equals_the_one_it_was(spark, index, tmp_path):
    e = Engine(spark, index, weights=[0.4, 0.2, 0.2, 0.1, 0.1])
    e.save(f"{tmp_path}/e", latent=True)
    again = Engine.load(spark, index.docs, f"{tmp_path}/e")
    assert again.weights == e.weights and again.latent is not None
    queries = spark.createDataFrame([(0, "chest pain"), (1, "walking hearts")], "query_id int, text string")
    for model in ("hybrid", "ltr"):  # between them they use every ranker
        a, b = (sorted(tuple(r) for r in x.rank(x.terms(queries), model, 4).collect()) for x in (e, again))
        assert a == b and a
    assert ids(again.search('"chest pain"')) == [2, 5] and ids(again.search("(heart OR breath) AND NOT walk")) == [1, 2, 3]
    assert again.health()["latent_dims"] == len(again.latent[1].first().v) and again.document(3).first().text == "pain chest heart"
    assert Engine.load(spark, index.docs, index_only(index, tmp_path)).latent is None
    (tmp_path / "bad").mkdir()
    assert articles.weights(spark, f"{tmp_path}/bad") is None and articles.latent(spark, f"{tmp_path}/bad") is None


def index_only(index, tmp_path):
    index.save(f"{tmp_path}/i")
    return f"{tmp_path}/i"


def test_stored_index_is_built_once(spark, index):
    made = []

    def build():
        made.append(1)
        return index

    a, b = (store.stored_index(spark, "of a test", build) for _ in range(2))
    assert a._saved["postings"].inputFiles() == b._saved["postings"].inputFiles() and a.statistics().first().n_docs == 8


def test_service(spark, index):
    e = Engine(spark, index)

    def ask(path, **params):
        status, body = service.respond(e, path, params)
        return status, json.loads(body)

    status, body = ask("/search", q='heart "chest pain" hearx', topk="1", type="treatment")
    assert status == 200 and [(r["rank"], r["doc_id"], r["type"]) for r in body["results"]] == [(1, 5, "treatment")]
    assert body["phrases"] == [["chest", "pain"]] and body["oov"] == {"hearx": ["heart"]} and body["type"] == "treatment" and body["mode"] == "phrase" and body["elapsed_ms"] >= 0
    assert "<mark>heart</mark>" in body["results"][0]["snippet"] and body["expanded_terms"] == []
    assert len(ask("/search", q="breath", expand="true")[1]["expanded_terms"]) > 0
    first, second = (ask("/search", q="pain", topk="2", page=p)[1]["results"] for p in ("1", "2"))
    assert [r["rank"] for r in first + second] == [1, 2, 3, 4] and len({r["doc_id"] for r in first + second}) == 4
    assert ask("/search", q=" ") == (400, {"error": "missing query"}) and ask("/search", q="x", topk="0")[0] == 500 and ask("/nowhere")[0] == 404
    assert ask("/suggest", prefix="che") == (200, ["chest"])
    assert [r["rank"] for r in ask("/similar", id="3", topk="2")[1]["similar"]] == [1, 2] and ask("/similar")[0] == 400
    stats = ask("/stats")[1]
    assert stats["docs"] == 8 and {"word": "pain", "df": 4} in stats["top_terms"]
    assert ask("/health")[1]["models"] == list(MODELS) and ask("/prcurve")[0] == 404 and service.respond(e, "/prcurve", {}, "{}") == (200, "{}")
    drawn = ask("/map", clusters="9")[1]
    assert {d["doc_id"] for d in drawn["docs"]} <= {1, 2, 3, 4, 5, 8} and all(set(d) == {"doc_id", "x", "y", "type", "cluster"} for d in drawn["docs"])
    assert all(len(c["keywords"]) == 4 for c in drawn["clusters"])


def test_command_line(spark, tmp_path, capsys):
    for k, (path, text) in enumerate([("diagnosis/Topic_1/2/11", "chest pain"), ("diagnosis/Topic_1/0/12", "heart rest"), ("test/Topic_2/1/13", "chest scan"), ("test/Topic_2/0/14", "pain of hearts")]):
        at = tmp_path / "a" / f"{path}.nxml"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"<article><front><article-meta><title-group><article-title>{text} {k}x</article-title></title-group></article-meta></front><body><p>{text} again</p></body></article>")
    (tmp_path / "t.xml").write_text('<topics><topic number="1" type="diagnosis"><description>heart</description><summary>chest pain</summary></topic><topic number="2" type="test"><description>d</description><summary>chest scan</summary></topic></topics>')
    common = ["--docs", str(tmp_path / "a"), "--index", str(tmp_path / "i")]
    command.main(["index", *common])
    command.main(["evaluate", *common, "--topics", str(tmp_path / "t.xml"), "--model", "all", "--output", str(tmp_path / "o"), "--topk", "2"])
    assert articles.weights(spark, str(tmp_path / "i/weights")) is not None
    run = {(r.model, r.query_id): r.doc_id for r in articles.run_file(spark, str(tmp_path / "o/run")).filter("rank = 1").collect()}
    assert run == {(m.upper(), q): d for m in MODELS for q, d in ((1, "11"), (2, "13"))}
    assert sorted(tuple(r) for r in articles.qrels(spark, str(tmp_path / "o/judgments")).collect()) == [(1, "11", 2), (1, "12", 0), (2, "13", 1), (2, "14", 0)]
    table = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "o/metrics")).collect()
    assert len(table) == 15 and {r.type for r in table} == {"DIAGNOSIS", "TEST", "-"}
    assert json.loads(spark.read.text(str(tmp_path / "o/curves")).first().value)["curves"]["bm25"][0] == 1.0
    capsys.readouterr()
    command.main(["topics", *common, "--topics", str(tmp_path / "t.xml"), "--topk", "1"])
    assert "|11    |" in capsys.readouterr().out
    command.main(["search", *common], lines=["chest", ":pain", "", "+heart", "exit", "never"])
    out = capsys.readouterr().out
    assert out.count("mode:") == 3 and out.count("snippet") == 1 and "pain of hearts 3x" in out
    command.main(["search", *common, "--query", "chest AND NOT pain", "--csv", str(tmp_path / "c")])
    assert [r.doc_id for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["13"]


def test_search_facade(spark, index):
    e = Engine(spark, index)
    assert ids(e.search("chest pain", "hybrid", 3, "diagnosis")) and set(ids(e.search("chest", kind="treatment"))) == {5}
    assert ids(e.search('"chest pain"')) == [2, 5] and ids(e.search('heart "chest pain"')) == [5]
    assert '"results":[{"rank":1' in e.search_response("breath").first().value
    assert e.stats().first().n_docs == 8 and e.health()["status"] == "ok"
    with pytest.raises(ValueError):
        e.search("x", k=0)
