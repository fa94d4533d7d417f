"""Rankings from the texts against those of a stored index, and what each query reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tarn import queries
from tarn.functions.stemming import identity_stem, light_stem
from tarn.functions.text import STOPWORDS
from tarn.operators import feedback, rankers, scan
from tarn.operators.index import Index


def _docs(spark, n=120, repeated=False):
    rng, rows = random.Random(7), []
    for i in range(n):
        words = [rng.choice("alpha beta gammas gamma Delta über straße the 42 walking walked walks".split() + [f"rare{rng.randrange(60)}"] * 3) for _ in range(rng.randrange(40))]
        rows.append((i, None if i == 3 else ", ".join(words)))
    rows += [(1000 + i, "alpha beta, walked") for i in range(40)] + [(2000, ""), (2001, "the 42")] + ([(5, "alpha")] if repeated else [])
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _terms(spark, index):
    asked = [(1, "alpha walking straße"), (2, "rare1 rare2 gammas gamma gamma"), (3, "unheard"), (4, "alpha beta"), (5, "the")]
    return rankers.query_terms(index, spark.createDataFrame(asked, "query_id int, text string"))


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = _docs(spark)
    return Index(docs), Index(docs).save(str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("model", ["bm25", "vsm", "semantic"])
@pytest.mark.parametrize("common", [3, 100_000])
def test_rankings_equal_those_of_a_stored_index(spark, both, model, common, monkeypatch):
    monkeypatch.setattr(scan, "COMMON", common)
    monkeypatch.setattr(scan, "CELLS", 64)
    monkeypatch.setattr(scan, "PENDING", 16)
    raw, stored = Index(both[0].docs), both[1]
    for k in (1, 7, 500):
        assert _rows(rankers.RANKERS[model](raw, _terms(spark, raw), k)) == _rows(rankers.RANKERS[model](stored, _terms(spark, stored), k))


def test_blocks_of_queries(spark, both, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_TERMS", 2)
    assert _rows(rankers.bm25(both[0], _terms(spark, both[0]), 9)) == _rows(rankers.bm25(both[1], _terms(spark, both[1]), 9))


def test_counts_equal_a_stored_index(both):
    raw, stored = both
    assert raw.scan().statistics().first() == stored.statistics().first()
    assert sorted(raw.stems().collect()) == sorted(stored.stems().select("stem", "df", "first_df").collect())
    assert sorted(raw.scan().vocabulary().collect()) == sorted(stored.vocabulary().select("word", "stem", "df").collect())
    expected = {r.doc_id: r.norm for r in stored.norms().collect()}
    assert all(abs(r.norm - expected[r.doc_id]) < 1e-9 for r in raw.scan().norms().collect())


def test_similar_documents_equal_a_stored_index(spark, both):
    sources = both[0].docs.filter("doc_id % 5 = 0").select("doc_id")
    assert _rows(feedback.similar(both[0], sources)) == _rows(feedback.similar(both[1], sources))


def test_repeated_ids_and_no_documents(spark, tmp_path):
    docs = _docs(spark, 30, repeated=True)
    raw, stored = Index(docs), Index(docs).save(str(tmp_path))
    assert raw.scan() is None and _rows(rankers.bm25(raw, _terms(spark, raw))) == _rows(rankers.bm25(stored, _terms(spark, stored)))
    empty = Index(docs.limit(0))
    assert empty.scan().statistics().first().n_docs == 0 and not rankers.vsm(empty, _terms(spark, empty)).collect()


def test_best_keeps_near_scores_and_few_of_equal_ones():
    best = scan.Best(2, 1)
    best.take(np.arange(9), np.arange(9), np.array([1.0] * 5 + [2.0, 1.0 - 1e-6, 0.5, 0.0]), True)
    which, doc, value = best.result()
    assert list(zip(doc, value)) == [(5, 2.0), (0, 1.0), (1, 1.0), (6, 1.0 - 1e-6)]


@pytest.mark.parametrize("name", ["boolean_and", "wildcard_docs", "proximity_spans", "phrase_count", "ltr_features"])
def test_no_query_saves_an_index_first(spark, name, monkeypatch):
    def save(*_):
        raise AssertionError("an index of all documents")

    monkeypatch.setattr(Index, "save", save)
    monkeypatch.setattr(Index, "stem_matrix", save)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] >= 0
    assert queries.Setting(spark, "/root/testdata/sf0.001").index._saved == {}


@pytest.mark.parametrize("name", ["wildcard_docs", "proximity_spans", "phrase_count"])
def test_tokens_are_not_shuffled_for_a_few_stems(spark, name):
    """The stems' size is known, so they are broadcast even where the documents are far too large for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    """A file of one row group is read by one task; its texts go on to all, and even files stay as they lie."""
    path = str(tmp_path / "docs")
    spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "concat('alpha rare', id) AS text").write.parquet(path)
    index = Index(spark.read.parquet(path))
    many = [len(rows) for rows in index.texts().rdd.glom().collect()]
    assert sum(many) == 4000 and max(many) * spark.sparkContext.defaultParallelism <= 2 * 4000
    even = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "'alpha' AS text")
    assert Index(even).texts().rdd.getNumPartitions() == 8


def test_words_that_cannot_have_a_stem_are_not_stemmed(spark, both):
    """Texts and words are sorted out by the stem they have to begin with, with the same tokens."""
    index = Index(both[0].docs)
    for stems in (["walk"], ["alpha", "gamma", "straße"], ["unheard"]):
        expected = index.tokens().filter(F.col("stem").isin(stems))
        assert sorted(map(tuple, index.tokens(stems).collect())) == sorted(map(tuple, expected.collect()))
    plan = index.tokens(["walk"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "StartsWith(" in plan


def test_documents_without_a_hit_are_joined_only_where_they_count():
    from tarn.plans.boolean import Parser, without

    for query, expected in (("a1x", False), ("a1x AND b1x", False), ("NOT a1x", True), ("a1x OR NOT b1x", True), ("a1x AND NOT b1x", False), ("NOT (NOT a1x)", False), ("NOT the", True)):
        assert without(Parser(query).parse()) is expected


def test_several_models_are_scored_in_one_pass(spark, both, monkeypatch):
    passes = []
    scored = scan.Scan._scored
    monkeypatch.setattr(scan.Scan, "_scored", lambda self, models, *rest: passes.append(tuple(models)) or scored(self, models, *rest))
    index = Index(both[0].docs)
    found = rankers.rank_each(["bm25", "vsm", "semantic"], index, _terms(spark, index), 7)
    assert passes == [("bm25", "vsm", "semantic")]
    for model, rows in found.items():
        assert _rows(rows) == _rows(rankers.RANKERS[model](both[1], _terms(spark, both[1]), 7))
    passes.clear()
    setting = queries.Setting(spark, "/root/testdata/sf0.001")
    setting.run(), setting.qrels()
    assert passes == [("bm25", "vsm")]


def test_passes_share_kept_texts(both):
    """Texts are cleaned once, and a pass over them runs no regular expression."""
    passes = Index(both[0].docs).scan()
    passes.counts(), passes.norms()
    plan = passes._texts()._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and passes._texts() is passes._texts()


def test_words_are_stemmed_as_arrow_arrays():
    import pyarrow as pa

    words = pa.array("the walking walks 42 42nd ings sings lists agedly über straßes é ssings gas".split())
    for stemmer in (light_stem, identity_stem):
        of, stems = scan._coded(words, frozenset(STOPWORDS), stemmer, {})
        codes, known = scan.stems_of(words.to_pylist(), frozenset(STOPWORDS), stemmer.word, {})
        name = list(known)
        assert [stems[int(i)].as_py() if i >= 0 else None for i in of] == [name[i] if i >= 0 else None for i in codes]


def test_texts_are_split_in_slices_of_bounded_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scan, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abcd", None, "abcdef", "a" * 30, "", "b"])], names=["doc_id", "text"])
    parts = list(scan.sliced(iter([batch]), 1))
    assert [p.num_rows for p in parts] == [3, 1, 2] and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
