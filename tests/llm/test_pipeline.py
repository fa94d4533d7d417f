"""The pipeline: every stage on what the one before it kept."""

import collections
import random

import pytest

import corpus_pipeline
from tarn.llm import mixing, near_dedup, quality


def corpus():
    rng = random.Random(8)
    short, long = ["the", "of", "and", "a", "to", "in", "it"], [f"{a}{b}{c}" for a in ("con", "tra", "per", "sub") for b in ("ven", "duc", "mit", "sis") for c in ("tion", "able", "ing", "ent")]

    def text(n):
        return ". ".join(" ".join(rng.choices(short + long, k=9)).capitalize() for _ in range(n)) + "."

    rows = [(i, text(rng.randrange(2, 12))) for i in range(150)]
    rows += [(1000 + i, " | ".join(rng.choices(long, k=60))) for i in range(25)]
    rows += [(2000 + i, rows[i][1]) for i in range(20)]
    rows += [(3000 + i, rows[i + 30][1] + " More.") for i in range(20) if len(rows[i + 30][1]) > 300]
    return [(i, t, "en", f"src{i % 4}", len(t)) for i, t in rows] + [(5000, None, None, None, 0), (5001, "", "en", "src0", 0)]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        if name != "packing":
            assert docs.columns == before.columns
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["quality"]}
    assert {r[0] for r in rows[:150]} <= kept and not {5000, 5001} & kept and len([i for i in kept if 1000 <= i < 2000]) <= 1
    exact = [r.text for r in seen["exact dedup"]]
    assert len(exact) == len(set(exact)) == len({r.text for r in seen["quality"]})
    assert {2000 + i for i in range(20)} <= {r.doc_id for r in seen["exact dedup"]}
    near = {r.doc_id for r in seen["near dedup"]}
    assert not any(i + 3000 in near and i + 30 in near for i in range(20)) and len(near) >= 140
    taken = collections.Counter(r.doc_id for r in seen["mixing"])
    assert set(taken) <= near and max(taken.values()) <= 2
    tokens = collections.defaultdict(int)
    for r in seen["packing"]:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert all(n == size * taken[i] for (i, size), n in tokens.items()) and {i for i, _ in tokens} == set(taken)
    assert [f.__module__ for f in (quality.keep_good, near_dedup.one_per_group, mixing.apply_mix)] == ["tarn.llm.quality", "tarn.llm.near_dedup", "tarn.llm.mixing"]


HELPERS = "of own times every mine other place copy verdict digest keep_id group_size kept tag cls crc _id _digest _n _t _all _kept _crc _crc2 _copy _k rank size h skey part shard k a.b `tick`".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_leave_columns_alone(spark, tmp_path, name, stage):
    """Columns named as the operators' own, null and repeated ids, and no rows at all."""
    data = corpus()[:60] + corpus()[:2] + [(None, corpus()[5][1], None, None, 1), (None, corpus()[7][1] + " And so on.", "en", "src1", 1), (7, "a text of a repeated id that the rest of us know. " * 3, "en", "src1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in HELPERS)
    marked = [(*row, *(f"{c}{k}" for c in HELPERS)) for k, row in enumerate(data)]
    docs = spark.createDataFrame(marked, schema)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.schema == docs.schema
    by = {row[5]: row for row in marked}
    got = [tuple(r) for r in out.collect()]
    assert got and all(by[r[5]] == r for r in got)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_packing_stage_on_odd_tables(spark, tmp_path):
    pack = corpus_pipeline.STAGES[4][1]
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (None, None, "z")], "doc_id long, text string, shard string")
    assert pack(spark, docs, str(tmp_path)).groupBy("doc_id").sum("length").count() == 2
    assert pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus()[:40], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns
