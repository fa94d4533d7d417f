"""Dense vectors: cosine ranking, a two-dimensional map, spherical k-means, latent semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from tarn.functions.text import dot, norm
from tarn.operators import latent
from tarn.operators.index import Index
from tarn.operators.rankers import ranked

#: Share of the ids by which an approximate quantile may miss.
QUANTILE_ERROR = 1e-3
#: Bytes of query vectors that go to tasks at a time.
QUERY_BYTES = 64 << 20
#: Documents up to which the latent model is solved exactly from their products, a matrix that the driver holds.
GRAM_ROWS = 2048
#: Rank of the latent model, as in the reference.
RANK = 160
#: Entries of the tf-idf matrix that a bucket stands for.
BUCKET_ROWS = 200_000


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """vectors(doc_id, v) and queries(query_id, v): cosines above 0, best first.

    Queries are searched in blocks of at most QUERY_BYTES, which go to the tasks; of a block's pairs only each
    query's k best in a batch of documents leave the task.
    """
    size = (queries.agg(F.max(F.size("v"))).first()[0] or 0) * 8
    kinds = {"query_id": queries.schema["query_id"].dataType, "doc_id": vectors.schema["doc_id"].dataType}
    schema = StructType([*(StructField(n, t) for n, t in kinds.items()), StructField("score", DoubleType())])
    blocks = max(1, -(-queries.count() * size // QUERY_BYTES))
    dealt, out = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")), None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("query_id", F.transform("v", lambda x: x.cast("double")).alias("v")).toPandas()  # QUERY_BYTES or so
        part = vectors.select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(_nearest(rows, k, to_arrow_type(kinds["query_id"])), schema)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def _nearest(queries: pd.DataFrame, k: int | None, kind: pa.DataType):
    """Over batches (doc_id, v): for each query the k best of the batch, with every tie of the last."""
    names, q = queries["query_id"].to_numpy(), np.array(queries["v"].tolist(), float).reshape(len(queries), -1 if len(queries) else 1)
    norms = np.linalg.norm(q, axis=1)
    names, q = names[norms > 0], q[norms > 0] / norms[norms > 0, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(names) or not batch.num_rows:
                continue
            v = _block(batch.column(1), q.shape[1])
            length = np.linalg.norm(v, axis=1)
            scores = np.round((v / np.maximum(length, 1e-300)[:, None]) @ q.T, 6)
            scores[length == 0] = 0
            good = scores > 0
            if k is not None and k < len(scores):
                good &= scores >= -np.partition(-scores, k - 1, axis=0)[k - 1]
            d, j = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(names[j].tolist(), kind), batch.column(0).take(pa.array(d)), pa.array(scores[d, j])], names=["query_id", "doc_id", "score"])

    return work


def map2d(vectors: DataFrame) -> DataFrame:
    """(doc_id, x, y): the first two dimensions over their largest absolute value."""
    top = vectors.agg(F.max(F.abs(F.col("v")[0])).alias("mx"), F.max(F.abs(F.col("v")[1])).alias("my"))

    def scaled(i: int, most: str) -> Column:
        return F.round(F.when(F.col(most) > 0, F.col("v")[i].cast("double") / F.col(most)).otherwise(0.0), 6)

    return vectors.crossJoin(F.broadcast(top)).select("doc_id", scaled(0, "mx").alias("x"), scaled(1, "my").alias("y"))  # top: one row


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors over their length, which is repeated beside the elements: inside the function of an element it would be summed anew for each."""
    n, v = norm(F.col("v")), F.transform("v", lambda x: x.cast("double"))
    return vectors.select("doc_id", F.when(n > 0, F.zip_with(v, F.array_repeat(n, F.size("v")), lambda x, y: x / y)).otherwise(v).alias("v"))


def seeds(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Rows c * n / C in id order are the first centroids.

    Approximate quantiles bracket each place, ids before the bracket are counted, and only those inside, a few
    thousandths of all however the ids are spread, are ordered.
    """
    ids = vectors.select("doc_id", F.col("doc_id").cast("double").alias("at"))
    n = ids.count()
    if not n:
        raise ValueError("no vectors")
    places = [c * n // clusters for c in range(min(clusters, n))]
    wide = 2 * QUANTILE_ERROR
    cuts = ids.approxQuantile("at", [x for p in places for x in (max(0.0, p / n - wide), min(1.0, p / n + wide))], QUANTILE_ERROR)
    low, high = cuts[::2], cuts[1::2]
    before = ids.agg(*(F.count_if(F.col("at") < x).alias(f"b{c}") for c, x in enumerate(low))).first()
    wanted = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(x).alias("low"), F.lit(y).alias("high"), F.lit(p - before[c] + 1).cast("long").alias("turn")) for c, (x, y, p) in enumerate(zip(low, high, places, strict=True))))
    inside = ids.select("doc_id", "at", F.explode(wanted).alias("w")).filter("at >= w.low and at <= w.high")
    turn = F.row_number().over(Window.partitionBy("w.c").orderBy("doc_id"))
    chosen = {r.c: r.doc_id for r in inside.select("doc_id", F.col("w.c").alias("c"), "w.turn", turn.alias("mine")).filter("mine = turn").collect()}
    rows = {r.doc_id: r.v for r in unit(vectors.filter(F.col("doc_id").isin(list(chosen.values())))).collect()}
    return np.array([rows[chosen[c]] for c in range(len(places))])


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(doc_id, v, cluster): the centroid with the highest dot product, ties to the lowest; rounded, so that sums in any order agree."""
    scores = [F.round(dot(F.col("v"), F.array(*[F.lit(float(x)) for x in c])), 9) for c in centroids]
    best = F.array_max(F.array(*scores))
    return vectors.withColumn("cluster", (F.array_position(F.array(*scores), best) - 1).cast("int"))


def centroids_of(vectors: DataFrame, before: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised means of what is nearest to each centroid; a cluster that is empty starts again from its first centroid.

    Each partition sums its own rows and one task per cluster the partitions' sums, so that the driver gets a
    row per cluster and no new code is compiled.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros_like(before)
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf["v"].tolist())
                np.add.at(out, np.argmax(np.round(v @ before.T, 9), axis=1), v)
        yield pd.DataFrame({"cluster": np.arange(len(out)), "s": list(out)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "s": [np.sum(pdf["s"].tolist(), axis=0)]})

    schema, whole = "cluster int, s array<double>", np.zeros_like(before)
    for r in vectors.select("v").mapInPandas(sums, schema).groupBy("cluster").applyInPandas(total, schema).collect():
        whole[r.cluster] = r.s
    size = np.linalg.norm(whole, axis=1, keepdims=True)
    return np.where(size > 1e-9, np.round(whole / np.maximum(size, 1e-12), 9), start)


def kmeans(vectors: DataFrame, clusters: int = 4, rounds: int = 30) -> tuple[DataFrame, np.ndarray]:
    """Spherical k-means: as many rounds of centroids, fewer if they stand still, and the last assignment.  The driver holds centroids only."""
    v = unit(vectors)
    start = seeds(vectors, clusters)
    c = start
    for _ in range(rounds):
        new = centroids_of(v, c, start)
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return assign(v, c), c


def _block(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Lists of `size` numbers as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


def lsa(spark: SparkSession, index: Index, k: int = RANK, passes: int = 120, tolerance: float = 1e-6, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Latent vectors of documents (doc_id, v) and stems (stem, idf, v): the singular vectors of the tf-idf matrix.

    The rank is k, or the number of documents or stems if that is less.  Up to GRAM_ROWS documents the products of
    all pairs are summed over buckets of stems and solved on the driver.  Beyond that blocks of document vectors are
    multiplied by the matrix and its transpose until no singular value moves by more than `tolerance` of itself, at
    most `passes` times (operators/latent.py).  Signs: the largest component of each document dimension is positive.
    asked(stem): the stems whose vectors the caller needs; without it all are made, and a small collection makes all.
    """
    from tarn.operators.store import Kept

    if index.docs.limit(GRAM_ROWS + 1).count() > GRAM_ROWS and index.scan():
        return latent.lsa(spark, index, None, k, passes, tolerance, asked)
    matrix = Kept(spark).table(index.stem_matrix().select("doc_id", "stem", "tf", "w", "df"), "matrix")
    held = matrix.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if not 0 < held.d <= GRAM_ROWS:
        return latent.lsa(spark, index, matrix, k, passes, tolerance, asked)
    n = index.statistics().select("n_docs")
    idf = matrix.groupBy("stem").agg(F.first("df").alias("df")).crossJoin(F.broadcast(n)).select("stem", F.log(F.col("n_docs").cast("double") / F.col("df")).alias("idf"))  # n: one row
    documents, stems = _exact_lsa(spark, matrix, k, held.d, held.n)
    return documents, stems.join(idf, "stem")


def _exact_lsa(spark: SparkSession, matrix: DataFrame, k: int, documents: int, entries: int) -> tuple[DataFrame, DataFrame]:
    """The same from the products of all pairs of documents; a stem's vector is its row of the matrix times theirs."""
    names = sorted(r.doc_id for r in matrix.select("doc_id").distinct().collect())  # GRAM_ROWS at most
    place = {name: i for i, name in enumerate(names)}
    buckets = int(min(8, max(1, entries // BUCKET_ROWS)))
    dealt = matrix.select("doc_id", "stem", F.col("w").cast("double").alias("w"), F.pmod(F.xxhash64("stem"), F.lit(buckets)).alias("bucket")).groupBy("bucket")

    def columns(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        stems, inverse = np.unique(part["stem"].to_numpy(), return_inverse=True)
        rows = np.array([place[x] for x in part["doc_id"].to_pylist()], np.int64)
        return stems, inverse, rows, part["w"].to_numpy()

    def products(part: pa.Table) -> pa.Table:
        stems, inverse, rows, w = columns(part)
        order = np.argsort(inverse, kind="stable")
        edge = np.searchsorted(inverse[order], np.arange(0, len(stems) + 2048, 2048))
        total = np.zeros((documents, documents))
        for a, b in zip(edge[:-1], edge[1:], strict=True):  # some stems at a time, as columns
            own = order[a:b]
            x = np.zeros((documents, 2048))
            x[rows[own], inverse[own] % 2048] = w[own]
            total += x @ x.T
        return pa.table({"g": pa.array([total.tobytes()], pa.binary())})

    gram = sum(np.frombuffer(bytes(r.g)).reshape(documents, documents) for r in dealt.applyInArrow(products, "g binary").collect())  # 8 matrices at most
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[: min(k, documents)]
    order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    sigma, u = np.sqrt(values[order]), vectors[:, order]
    u = u * np.where(np.abs(u).max(axis=0) == u.max(axis=0), 1, -1)

    def project(part: pa.Table) -> pa.Table:
        stems, inverse, rows, w = columns(part)
        out = np.zeros((len(stems), len(sigma)))
        for a in range(0, len(rows), 1 << 16):
            np.add.at(out, inverse[a : a + (1 << 16)], u[rows[a : a + (1 << 16)]] * w[a : a + (1 << 16), None])
        return pa.table({"stem": pa.array(stems.tolist(), pa.string()), "v": _lists(out / sigma)})

    kind = matrix.schema["doc_id"].dataType.simpleString()
    rows = spark.createDataFrame([(name, v) for name, v in zip(names, (u * sigma).tolist(), strict=True)], f"doc_id {kind}, v array<double>")
    return rows, dealt.applyInArrow(project, "stem string, v array<double>")


def project(terms: DataFrame, stems: DataFrame) -> DataFrame:
    """Queries (query_id, stem, qtf) as latent vectors (query_id, v)."""
    rows = terms.join(stems, "stem").select("query_id", F.posexplode(F.transform("v", lambda x: x * F.col("qtf") * F.col("idf"))).alias("i", "x"))
    sums = rows.groupBy("query_id", "i").agg(F.sum("x").alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return sums.select("query_id", F.col("v.x").alias("v"))


def cluster_keywords(stems: DataFrame, centroids: np.ndarray, n: int = 4) -> DataFrame:
    """(cluster, stem, score, rank): stems nearest to each centroid."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array(pdf["v"].tolist())
            s = v @ centroids.T / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            yield pd.DataFrame({"cluster": np.repeat(np.arange(len(centroids)), len(pdf)), "stem": np.tile(pdf["stem"], len(centroids)), "score": s.T.ravel()})

    scores = stems.select("stem", "v").mapInPandas(near, "cluster int, stem string, score double")
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 6)), "stem")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
