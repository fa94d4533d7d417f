"""Incremental indexing gives the index of all documents."""

from tarn.operators import rankers
from tarn.operators.index import Index
from tarn.streaming.incremental import index_stream, refresh


def test_stream_equals_batch(spark, tmp_path):
    schema, source = "doc_id long, text string", f"{tmp_path}/in"
    parts = [[(1, "chest pain"), (2, "heart pain pain")], [(3, "chest heart"), (4, None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    docs = spark.read.parquet(source)
    terms = spark.createDataFrame([(0, "pain", 1), (0, "heart", 1)], "query_id int, stem string, qtf long")
    streamed, batch = refresh(docs, f"{tmp_path}/index"), Index(docs)
    for ranker in (rankers.bm25, rankers.vsm):
        assert ranker(streamed, terms).orderBy("rank").collect() == ranker(batch, terms).orderBy("rank").collect()


def test_a_document_sent_again_replaces_itself(spark, tmp_path):
    schema, source = "doc_id long, text string", f"{tmp_path}/in"
    for rows in ([(1, "chest pain"), (2, "heart pain")], [(1, "arm"), (3, "pain")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    docs = spark.createDataFrame([(1, "arm"), (2, "heart pain"), (3, "pain")], schema)
    streamed, now = refresh(docs, f"{tmp_path}/index"), Index(docs)
    assert sorted(map(tuple, streamed.frequencies().collect())) == sorted(map(tuple, now.frequencies().collect()))
    assert sorted(map(tuple, streamed.lengths().collect())) == sorted(map(tuple, now.lengths().collect()))
