"""Rankings straight from the texts, for an index that is not stored: a few passes over the documents.

Texts are lower-cased and cleaned once by the same expression as everywhere and kept, in row groups that all tasks share.
A pass splits each text in a task, where all words of a document meet, so that no posting is shuffled.  The first counts documents for each word and stem; the
second, for models that divide by a document's length as a vector, sums the squares of the COMMON most frequent
stems and hands on only the words of all others, which a join weighs; the last scores documents against all queries
by one or several models and keeps what may be among each query's k best.  Every document and every word counts: nothing is approximate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tarn.functions.stemming import Stemmer
from tarn.functions.text import cleaned

if TYPE_CHECKING:
    from tarn.operators.index import Index

#: Stems whose document frequencies go to every task of the second pass.
COMMON = 100_000
#: Bytes of a row group of kept texts, and of texts that a task splits at a time.
GROUP_BYTES, SLICE_BYTES = 16 << 20, 32 << 20
#: Query terms that go to tasks at a time.
BLOCK_TERMS = 2_000_000
#: Scores of documents by queries, products, and candidates that a task holds at a time.
CELLS, PRODUCTS, PENDING = 1 << 21, 1 << 21, 1 << 20
#: Scores nearer than this may change places when they are rounded.
NEAR = 2e-6
K1, B = 1.5, 0.75
NUMBER = re.compile("[0-9]+")


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row and code of each word of cleaned texts, the distinct words, and the number of words of each row."""
    lists = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    coded = flat.filter(full).dictionary_encode()
    row = row[full.to_numpy(zero_copy_only=False)]
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.bincount(row, minlength=len(texts))


def _counted(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of row and code in order, and how often each occurs."""
    pairs, n = np.unique(row * max(codes, 1) + code, return_counts=True)
    return pairs // max(codes, 1), pairs % max(codes, 1), n


def stems_of(words: list[str], stopwords: frozenset[str], stem: Callable[[str], str], known: dict[str, str | None]) -> tuple[np.ndarray, dict[str, int]]:
    """Code of each word's stem, -1 for words that are not indexed, and the stems' codes; known: what was found before."""
    of, stems = np.full(len(words), -1, np.int64), {}
    if len(known) > 1 << 20:
        known.clear()
    for i, word in enumerate(words):
        s = known.get(word, 0)
        if s == 0:
            s = known[word] = None if word in stopwords or NUMBER.fullmatch(word) else stem(word)
        if s is not None:
            of[i] = stems.setdefault(s, len(stems))
    return of, stems


def _coded(names: pa.Array, stopwords: frozenset[str], stemmer: Stemmer, known: dict[str, str | None]) -> tuple[np.ndarray, pa.Array]:
    """Code of each word's stem, -1 for words that are not indexed, and the stems; at once where the stemmer takes an Arrow array."""
    if stemmer.arrow is None:
        of, stems = stems_of(names.to_pylist(), stopwords, stemmer.word, known)
        return of, pa.array(list(stems), pa.string())
    no = pc.or_(pc.is_in(names, value_set=pa.array(sorted(stopwords), pa.string())), pc.match_substring_regex(names, "^[0-9]+$"))
    coded = pc.if_else(no, pa.scalar(None, pa.string()), stemmer.arrow(names)).dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE_BYTES of texts, those in column `at`, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def _looked_up(names: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of names among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Scan:
    """The passes over the documents of an index."""

    def __init__(self, index: Index):
        self.index, self.spark, self._made = index, index.docs.sparkSession, {}
        self.kind = index.docs.schema["doc_id"].dataType

    def possible(self) -> bool:
        """Whether words can be stemmed in tasks and every id stands for one row."""
        if "possible" not in self._made:
            ids = self.index.docs.groupBy("doc_id").agg(F.count("*").alias("n"))
            good = self.index.stem.name != "custom" and not ids.filter("n > 1 or doc_id is null").limit(1).collect()
            self._made["possible"] = good
        return self._made["possible"]

    def _kept(self, name: str, make: Callable[[], DataFrame], **options) -> DataFrame:
        from tarn.operators.store import keep

        if name not in self._made:
            self._made[name] = keep(self.spark, make(), name, **options)
        return self._made[name]

    def has(self, name: str) -> bool:
        return name in self._made

    def _texts(self) -> DataFrame:
        rows = self.index.texts().select("doc_id", cleaned(F.col("text")).alias("text"))
        return self._kept("texts", lambda: rows, **{"parquet.block.size": GROUP_BYTES})

    # ---- first pass ---------------------------------------------------------------------------------------

    def counts(self) -> DataFrame:
        """(word, stem, df, length): documents of each word; without a word, what to add to the sum over a stem's words for
        the documents that have the stem; without a stem, the number of documents and of their words."""
        return self._kept("counts", self._count)

    def _count(self) -> DataFrame:
        stopwords, stemmer = frozenset(self.index.stopwords), self.index.stem

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, str | None] = {}
            for batch in sliced(batches, 0):
                row, code, names, lengths = split(batch.column(0))
                row, code, _ = _counted(row, code, len(names))
                of, named = _coded(names, stopwords, stemmer, known)
                df = np.bincount(code, minlength=len(names))
                index = np.nonzero(of >= 0)[0]
                several = np.bincount(of[index], minlength=len(named)) > 1  # a stem of one word has that word's documents
                some = index[several[of[index]]]
                mine = np.zeros(len(names), bool)
                mine[some] = True
                mine = mine[code]
                _, s, _ = _counted(row[mine], of[code[mine]], len(named))
                more = np.bincount(s, minlength=len(named)) - np.bincount(of[some], df[some], minlength=len(named)).astype(np.int64)
                fix = np.nonzero(more)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([names.take(pa.array(index)), pa.nulls(len(fix) + 1, pa.string())]),
                        pa.concat_arrays([named.take(pa.array(of[index])), named.take(pa.array(fix)), pa.nulls(1, pa.string())]),
                        pa.array(np.concatenate([df[index], more[fix], [len(lengths)]]).astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(index) + len(fix)), [lengths.sum()]]).astype(np.int64)),
                    ],
                    names=["word", "stem", "df", "length"],
                )

        rows = self._texts().select("text").mapInArrow(count, "word string, stem string, df long, length long")
        return rows.groupBy("word", "stem").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))

    def vocabulary(self) -> DataFrame:
        """(word, stem, df)."""
        return self.counts().filter("word is not null").select("word", "stem", "df")

    def stems(self) -> DataFrame:
        """(stem, df, first_df)."""
        rows = self.counts().filter("stem is not null").groupBy("stem")
        return self._kept("stems", lambda: rows.agg(F.sum("df").alias("df"), F.min_by("df", "word").alias("first_df")))

    def statistics(self) -> DataFrame:
        """One row (n_docs, avgdl)."""
        n, length = F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))
        return self.counts().filter("stem is null").agg(n.alias("n_docs"), F.when(n > 0, length / n).otherwise(0.0).alias("avgdl"))

    def _numbers(self) -> tuple[int, float]:
        if "numbers" not in self._made:
            self._made["numbers"] = tuple(self.statistics().first())
        return self._made["numbers"]

    # ---- second pass --------------------------------------------------------------------------------------

    def norms(self) -> DataFrame:
        """(doc_id, norm, dn): lengths of each document's vectors of words and of stems, 0 without index words."""
        return self._kept("norms", self._norms)

    def _norms(self) -> DataFrame:
        n = float(self._numbers()[0])
        stems = self.stems()
        common = stems.orderBy(F.desc("df"), "stem").limit(COMMON).select("stem", F.col("df").alias("sdf"))
        table = self.vocabulary().join(F.broadcast(common), "stem").select("word", "stem", "df", "sdf").toArrow()  # of COMMON stems
        known = table["word"].combine_chunks()
        coded = table["stem"].combine_chunks().dictionary_encode()
        of, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        idf = np.log(n / table["df"].to_numpy().astype(float))
        sidf = np.zeros(size)
        sidf[of] = np.log(n / table["sdf"].to_numpy().astype(float))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                ids, rows = batch.column(0), batch.num_rows
                row, code, names, _ = split(batch.column(1))
                row, code, tf = _counted(row, code, len(names))
                present = _looked_up(names, known)
                at = present[code]
                own, other = at >= 0, at < 0
                words = np.bincount(row[own], (tf[own] * idf[at[own]]) ** 2, minlength=rows)
                stem = of[at[own]]
                several = np.bincount(of[present[present >= 0]], minlength=max(size, 1)) > 1  # only words of one stem have to meet
                meet, alone = several[stem], ~several[stem]
                squares = np.bincount(row[own][alone], (tf[own][alone] * sidf[stem[alone]]) ** 2, minlength=rows)
                pairs, place = np.unique(row[own][meet] * max(size, 1) + stem[meet], return_inverse=True)
                whole = np.bincount(place, tf[own][meet], minlength=len(pairs)) * sidf[pairs % max(size, 1)] if len(pairs) else np.zeros(0)
                squares = squares + np.bincount(pairs // max(size, 1), whole**2, minlength=rows)
                rest = int(other.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids, ids.take(pa.array(row[other]))]),
                        pa.concat_arrays([pa.nulls(rows, pa.string()), names.take(pa.array(code[other]))]),
                        pa.array(np.concatenate([np.zeros(rows, np.int64), tf[other]])),
                        pa.array(np.concatenate([words, np.zeros(rest)])), pa.array(np.concatenate([squares, np.zeros(rest)])),
                    ],
                    names=["doc_id", "word", "tf", "words", "stems"],
                )

        schema = StructType([StructField("doc_id", self.kind), StructField("word", StringType()), StructField("tf", LongType()), StructField("words", DoubleType()), StructField("stems", DoubleType())])
        parts = self._kept("norm-parts", lambda: self._texts().mapInArrow(add, schema))
        rare = stems.join(F.broadcast(common.select("stem")), "stem", "left_anti").select("stem", F.col("df").alias("sdf"))
        known_rare = self.vocabulary().join(rare.hint("shuffle_hash"), "stem")
        left = parts.filter("word is not null").select("doc_id", "word", "tf").join(known_rare.hint("shuffle_hash"), "word")

        def square(df: str):
            return F.pow(F.col("tf") * F.log(F.lit(n) / F.col(df)), 2)

        by_stem = left.groupBy("doc_id", "stem").agg(F.sum(square("df")).alias("words"), F.sum("tf").alias("tf"), F.first("sdf").alias("sdf"))
        both = parts.filter("word is null").select("doc_id", "words", "stems").unionByName(by_stem.select("doc_id", "words", square("sdf").alias("stems")))
        return both.groupBy("doc_id").agg(F.sqrt(F.sum("words")).alias("norm"), F.sqrt(F.sum("stems")).alias("dn"))

    # ---- last pass ----------------------------------------------------------------------------------------

    def scores(self, model: str, terms: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score), unrounded: at least what is among the k best of each query by bm25, vsm or semantic."""
        return self.scores_by([model], terms, k).drop("model")

    def scores_by(self, models: Sequence[str], terms: DataFrame, k: int) -> DataFrame:
        """(model, query_id, doc_id, score) of several models, whose scores are taken in one pass."""
        from tarn.operators.store import keep

        terms = keep(self.spark, terms, "terms")
        blocks, out = max(1, -(-terms.count() // BLOCK_TERMS)), None
        for block in range(blocks):
            own = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            part = self._scored(models, own, k)
            out = part if out is None else out.unionByName(part)
        return out

    def _scored(self, models: Sequence[str], terms: DataFrame, k: int) -> DataFrame:
        n, average = self._numbers()
        asked = terms.select("query_id", "stem", "qtf").toArrow()  # BLOCK_TERMS or so
        stems = terms.select("stem").distinct()
        words = self.vocabulary().join(stems, "stem").withColumn("sdf", F.col("df"))
        if "semantic" in models:
            words = words.drop("sdf").join(self.stems().join(stems, "stem", "left_semi").select("stem", F.col("df").alias("sdf")), "stem")
        words = words.select("word", "stem", "df", "sdf").toArrow()  # the words of those stems
        named = words["stem"].combine_chunks().unique()
        at = _looked_up(asked["stem"].combine_chunks(), named)
        queries = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        ids, query = queries.dictionary, queries.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        qtf = asked["qtf"].to_numpy().astype(float)
        query, qtf, at = query[at >= 0], qtf[at >= 0], at[at >= 0]
        of, df, size = _looked_up(words["stem"].combine_chunks(), named), words["df"].to_numpy().astype(float), len(ids)
        known = words["word"].combine_chunks()
        order = np.argsort(at, kind="stable")
        idfs, weights = {}, {}
        for model in models:
            weight = np.ones(len(query)) if model == "bm25" else qtf
            if model == "bm25":
                idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
            elif model == "vsm":
                idf = np.log(n / df) ** 2
            else:
                idf, sidf = np.log(n / words["sdf"].to_numpy().astype(float)), np.zeros(len(named))
                sidf[of] = idf
                weight = qtf * sidf[at]
                lengths = np.sqrt(np.bincount(query, weight**2, minlength=size))
                weight = np.where(lengths[query] > 0, weight / np.where(lengths > 0, lengths, 1)[query], 0.0)
            idfs[model], weights[model] = idf, weight[order]
        query = query[order]
        first, many = np.searchsorted(at[order], np.arange(len(named) + 1))[:-1], np.bincount(at, minlength=len(named))
        kind, docs = to_arrow_type(self.kind), self._texts()
        if set(models) != {"bm25"}:
            docs = docs.join(self.norms().hint("shuffle_hash"), "doc_id").select("doc_id", "text", "norm", "dn")

        def divided(model: str, batch: pa.RecordBatch, row: np.ndarray, code: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            """Weight of each word in its document."""
            if model == "bm25":
                return idfs[model][code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / max(1.0, average)))
            by = batch.column(2 if model == "vsm" else 3).to_numpy(zero_copy_only=False)[row]
            return np.where(by > 0, idfs[model][code] * tf / np.where(by > 0, by, 1), 0.0)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {model: Best(k, size) for model in models}
            for batch in sliced(batches, 1):
                if not len(known) or not size or not batch.num_rows:
                    continue
                row, code, names, length = split(batch.column(1))
                place = _looked_up(names, known)
                own = place[code] >= 0
                row, code, tf = _counted(row[own], place[code[own]], len(known))  # each word that some query asks for
                stem, w = of[code], {model: divided(model, batch, row, code, tf, length) for model in models}
                names = batch.column(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.bincount(row, many[stem], minlength=len(names)))
                a, step = 0, max(1, CELLS // size)
                while a < len(names):
                    done = ends[a - 1] if a else 0
                    b = max(a + 1, min(a + step, int(np.searchsorted(ends, done + PRODUCTS, "right"))))
                    lo, hi = np.searchsorted(row, [a, b])
                    times = many[stem[lo:hi]]
                    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[stem[lo:hi]], times)
                    cell = np.repeat((row[lo:hi] - a) * size, times) + query[turn]
                    for model in models:
                        best[model].take(names[a:b], cell, np.repeat(w[model][lo:hi], times) * weights[model][turn], model != "semantic")
                    a = b
            for model in models:
                which, doc, value = best[model].result()
                for a in range(0, len(which), 10_000):
                    part = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model] * len(which[part]), pa.string()), ids.take(pa.array(which[part])), pa.array(doc[part].tolist(), kind), pa.array(value[part])],
                        names=["model", "query_id", "doc_id", "score"],
                    )

        schema = StructType([StructField("model", StringType()), StructField("query_id", terms.schema["query_id"].dataType), StructField("doc_id", self.kind), StructField("score", DoubleType())])
        return docs.mapInArrow(score, schema)


class Best:
    """The k best documents of each query so far, with those that rounding may put among them; of equal scores the smallest ids."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held, self.parts, self.pending = 0, [], 0

    def take(self, names: np.ndarray, cell: np.ndarray, value: np.ndarray, zeros: bool) -> None:
        """Add products by cell = row * queries + query; zeros: a sum of 0 counts as found too."""
        size = len(self.least)
        sums = np.bincount(cell, value, minlength=len(names) * size).reshape(len(names), size)
        found = sums > 0
        if zeros and len(value) and value.min() <= 0:
            found = np.bincount(cell, minlength=len(names) * size).reshape(found.shape) > 0
        d, q = np.nonzero(found & (sums >= self.least))
        self.parts.append((q, names[d], sums[d, q]))
        self.pending += len(d)
        if self.pending > max(PENDING, 2 * self.held):
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        q, doc, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        _, place = np.unique(doc, return_inverse=True)
        order = np.lexsort((place, -value, q))
        q, doc, value = q[order], doc[order], value[order]
        start = np.searchsorted(q, np.arange(len(self.least)))
        many = np.bincount(q, minlength=len(self.least))
        full = many >= self.k
        self.least[full] = value[start[full] + self.k - 1] - NEAR
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (value[1:] != value[:-1])]) if len(q) else np.zeros(0, bool)
        at = np.arange(len(q))
        alike = at - np.maximum.accumulate(np.where(new, at, 0))
        good = (at - start[q] < self.k) | ((value >= self.least[q]) & (alike < self.k))
        self.parts = [(q[good], doc[good], value[good])]
        self.pending = self.held = int(good.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.shrink()
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
