"""The latent model of many documents against a dense decomposition."""

import numpy as np
import pytest

from tarn.operators import latent, vectors
from tarn.operators.index import Index


def _docs(spark, text_ids=False):
    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        own = [f"w{'abcdefghij'[x // 10 % 10]}{'klmnoprtuv'[x % 10]}" for x in np.minimum(rng.zipf(1.4, rng.integers(0, 40)), 99)]
        rows.append((f"d{i}" if text_ids else i * 7, " ".join([*own, *["onlyhere" + "abcdefghij"[i % 10] * (i // 10)] * (i % 3 == 0)])))
    rows.append(("none" if text_ids else 9999, None))
    return spark.createDataFrame(rows, f"doc_id {'string' if text_ids else 'long'}, text string").repartition(3)


def _dense(index):
    m = index.stem_matrix().toPandas().pivot_table(index="doc_id", columns="stem", values="w", fill_value=0.0)
    return m, np.linalg.svd(m.to_numpy().astype(float), full_matrices=False)


@pytest.mark.parametrize("text_ids", [False, True])
def test_few_products_give_the_singular_values(spark, monkeypatch, text_ids):
    monkeypatch.setattr(vectors, "GRAM_ROWS", 0)
    monkeypatch.setattr(latent, "STEP", 16)
    products, before = [], latent.Packed.times
    monkeypatch.setattr(latent.Packed, "times", lambda self, u: products.append(u.shape) or before(self, u))
    index = Index(_docs(spark, text_ids))
    matrix, (u, s, vt) = _dense(index)
    documents, stems = vectors.lsa(spark, index, k=10)
    assert sum(columns for _, columns in products) <= len(matrix)  # before: twice the rank in each of up to 120 passes
    rows = {r.doc_id: r.v for r in documents.collect()}
    assert set(rows) == set(matrix.index)
    d = np.array([rows[x] for x in matrix.index])
    assert np.allclose(np.linalg.norm(d, axis=0), s[:10], rtol=2e-6)
    assert np.allclose(d @ d.T, (u[:, :10] * s[:10] ** 2) @ u[:, :10].T, atol=1e-3 * s[0])
    held = {r.stem: (r.idf, r.v) for r in stems.collect()}
    assert set(held) == set(matrix.columns)
    v = np.array([held[x][1] for x in matrix.columns])
    assert np.allclose(d @ v.T, (u[:, :10] * s[:10]) @ vt[:10], atol=1e-3 * s[0])


def test_asked_stems_and_a_stored_index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "GRAM_ROWS", 0)
    monkeypatch.setattr(latent, "BLOCK_BYTES", 8000)  # few columns go out at a time
    index = Index(_docs(spark))
    documents, stems = vectors.lsa(spark, index, k=5)
    asked = spark.createDataFrame([("wal",), ("wam",), ("unheard",)], "stem string")
    some = vectors.lsa(spark, index, k=5, asked=asked)[1].collect()
    every = {r.stem: r.v for r in stems.collect()}
    assert {r.stem for r in some} == {"wal", "wam"} and all(np.allclose(r.v, every[r.stem], atol=1e-4) for r in some)
    stored = vectors.lsa(spark, index.save(str(tmp_path)), k=5)[0]
    a, b = ({r.doc_id: r.v for r in x.collect()} for x in (documents, stored))
    x, y = (np.array([m[i] for i in sorted(a)]) for m in (a, b))
    assert set(a) == set(b) and np.allclose(x @ x.T, y @ y.T, atol=1e-3 * np.linalg.norm(x[:, 0]))


def test_no_index_words(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GRAM_ROWS", 0)
    index = Index(spark.createDataFrame([(1, "the 42"), (2, None)], "doc_id long, text string"))
    documents, stems = vectors.lsa(spark, index)
    assert not documents.collect() and not stems.collect()


def test_a_vector_is_measured_once(spark):
    """The length stands outside the function of an element, where it was summed for each of the elements."""
    v = vectors.unit(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "doc_id long, v array<double>"))
    assert sorted(tuple(r.v) for r in v.collect()) == [(0.0, 0.0), (0.6, 0.8)]
    assert "array_repeat(SQRT(aggregate(" in v._jdf.queryExecution().analyzed().toString()
