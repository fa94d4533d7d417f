"""Readers and writers on small files of our own."""

from pyspark.sql import functions as F

from tarn.sources import articles as A
from tarn.sources import sinks as S

XML = """<?xml version="1.0"?>
<!DOCTYPE article PUBLIC "-//X//DTD//EN" "none.dtd">
<article><front><journal-meta><journal-title-group><journal-title>J of Tests</journal-title></journal-title-group><publisher><publisher-name>P</publisher-name></publisher></journal-meta>
<article-meta><article-categories><subj-group><subject>Case</subject></subj-group></article-categories><title-group><article-title>Chest <italic>pain</italic> study</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>A</given-names></name></contrib></contrib-group><abstract><p>One.</p><p>Two.</p></abstract></article-meta></front>
<body><p>Body text.</p></body><back><ref-list><ref><article-title>Other</article-title></ref></ref-list></back></article>"""


def test_articles_and_judgments(spark, tmp_path):
    for path in ("diagnosis/Topic_1/2/11.nxml", "test/Topic_14/0/12.nxml"):
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_text(XML)
    got = {r.doc_id: r for r in A.articles(spark, str(tmp_path)).collect()}
    r = got["11.nxml"]
    assert (r.type, r.title, r.abstract, r.body, r.journal, r.publisher) == ("diagnosis", "Chest pain study", "One. Two.", "Body text.", "J of Tests", "P")
    assert r.authors == ["Doe", "A"] and r.categories == ["Case"]
    assert "Chest pain study One. Two. Body text." in A.as_documents(A.articles(spark, str(tmp_path))).first().text
    assert sorted(tuple(x) for x in A.judgments(spark, str(tmp_path)).collect()) == [(1, "11", 2), (14, "12", 0)]


def test_topics_and_words(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<topics><topic number="3" type="test"><description>D d</description><summary>S</summary></topic></topics>')
    assert tuple(A.topics(spark, str(tmp_path / "t.xml")).first()) == (3, "test", "D d", "S")
    (tmp_path / "w.txt").write_text("﻿και\n The \n\nof\n", encoding="utf-8")
    assert A.stopwords(spark, str(tmp_path / "w.txt")) == ["of", "the", "και"] and A.stopwords(spark, str(tmp_path / "none")) == []
    row = spark.range(1).select(A.query_string(F.lit("q=a%20b+c&x&k=v=w")).alias("m")).first().m
    assert row == {"q": "a b c", "x": "", "k": "v=w"}


def test_run_and_judgment_files(spark, tmp_path):
    run = spark.createDataFrame([(1, "a", 1.5, 1, "bm25")], "query_id int, doc_id string, score double, rank int, model string")
    S.write_text(S.run_lines(run), str(tmp_path / "run"))
    assert tuple(A.run_file(spark, str(tmp_path / "run")).first()) == (1, "a", 1, 1.5, "BM25")
    qrels = spark.createDataFrame([(1, "a", 2)], "query_id int, doc_id string, rel int")
    S.write_text(S.qrels_lines(qrels), str(tmp_path / "qrels"))
    assert tuple(A.qrels(spark, str(tmp_path / "qrels")).first()) == (1, "a", 2)
    assert '"curves":{"bm25":[1.0,' in S.curve_json(run, qrels).first().value
    S.write_csv(run, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().doc_id == "a"
