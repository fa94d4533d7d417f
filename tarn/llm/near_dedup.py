"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles.  The sketch follows Dahlgaard, Knudsen and Thorup (2017): in
round i each element is thrown into one of t bins with a value that grows with i, each bin keeps its least
value, and rounds go on until every bin is filled; rounds t to 2t - 1 send all elements to one bin each, so
no coordinate stays empty.  A set of n elements costs O(n + t log t), and two sketches agree in a coordinate
with the Jaccard similarity of the sets, concentrated as in Chernoff's bounds.

Rows with one and the same set form a class; only classes go on.  32 bands of 4 coordinates are matched: a
pair at similarity 0.8 shares none with probability 5e-8.  Bands with up to 12 classes compare all pairs.
A larger band compares all its classes with one pivot, the class that meets the most others over all bands,
so that a group of copies around an original is settled in one linear step.  What a pivot leaves open is
settled by blocks: the classes that share a large band with the pivot but are not connected to it are compared
with all of the pivot's classes that they could link to, 256 by 256 inside tasks.  First sketches alone go to the
blocks, which name the classes that have a partner there; the texts of these follow, and links alone return.
Jaccard distance obeys the triangle inequality, so classes nearer to the pivot than the least distance of the open
ones less 0.2 are spared; for that the distances of all open classes are measured, and another class whose distance
was not counts as far away.  Pairs are verified on full sets.  Pairs whose sketches agree in fewer coordinates than
all but 1e-12 of pairs at the wanted similarity do (67 of 128 at 0.8) are not fetched to be linked.

Defined results: text that is null, empty or blank has the empty set and is linked with nothing; fewer words
than a shingle make one shingle; equal sets are linked at any size; a null doc_id is never the smallest,
unless all of its component are null; rows that repeat a doc_id count as separate documents with that id;
an empty table gives an empty result.  Set elements are 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import Scratch, named, partitions, unused
from tarn.llm.components import components

COORDINATES = 128
BAND_ROWS = 4
ALL_PAIRS = 12
#: Partners of a pivot that are verified in one group.
BLOCK = 64
#: Classes in a block of those that pivots leave open, and shingles that a block has about at most.
OPEN_BLOCK, OPEN_SHINGLES = 256, 4 << 20


def agreement(similarity: np.ndarray) -> np.ndarray:
    """For each similarity a row: how probable it is that at most 0, 1 .. COORDINATES coordinates agree."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, COORDINATES + 1)))])
    k, s = np.arange(COORDINATES + 1), np.clip(similarity, 1e-12, 1 - 1e-12)[:, None]
    return np.cumsum(np.exp(log[-1] - log[k] - log[::-1] + k * np.log(s) + (COORDINATES - k) * np.log(1 - s)), axis=1)


def least_agreeing(percent: int) -> int:
    """Coordinates that must agree before a pair's texts are fetched."""
    return int(np.searchsorted(agreement(np.array([percent / 100]))[0], 1e-12))


def fast_sketch(elements: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketches of the sets elements[first[d]:first[d + 1]], a row of t coordinates each; t is a power of two up to 128."""
    docs = len(first) - 1
    out = np.full(docs * t, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(first))
    live, x, bits = elements, owner, np.uint64(64 - (t.bit_length() - 1))
    body = np.uint64((1 << 56) - 1)
    for i in range(2 * t):
        if not len(live):
            break
        h = flat.mix64(live + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h & body) | np.uint64(i << 56)
        where = x * t + ((h >> bits).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, where, value)
        done = (out.reshape(docs, t) != np.iinfo(np.uint64).max).all(axis=1)
        if done.any():
            stay = ~done[x]
            live, x = live[stay], x[stay]
    return out.reshape(docs, t)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles, A-Z folded."""
    w = flat.words(data, at, fold=True)
    hashes, place = flat.windows(w.hash, w.first, size)
    edge = np.searchsorted(place, w.first)
    out = []
    for d in range(len(at) - 1):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= size:
            out.append(np.unique(hashes[edge[d] : edge[d + 1]]))
        elif b > a:
            short = np.uint64(b - a)
            for h in w.hash[a:b]:
                short = flat.mix64(np.array([short]) * np.uint64(0x2545F4914F6CDD1D) + h)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tag, n (set size), cls (digest of the set, null if empty), bands, sk (a byte of each coordinate)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                sets = shingle_sets(data, at, size)
                n = np.array([len(s) for s in sets], np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                sketch = fast_sketch(np.concatenate([*sets, np.zeros(0, np.uint64)]), first)
                shape = sketch.reshape(len(sets), -1, BAND_ROWS)
                band = np.zeros(shape.shape[:2], np.uint64)
                for j in range(BAND_ROWS):
                    band = flat.mix64(band * np.uint64(0x9E3779B97F4A7C15) + shape[:, :, j] + np.arange(shape.shape[1], dtype=np.uint64))
                low = flat.mix64(sketch).astype(np.uint8)
                some = n > 0
                flatbands = pa.array(band.view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * shape.shape[1]), flatbands)
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(cls, pa.binary()), bands, pa.array([x.tobytes() if s else None for x, s in zip(low, some, strict=True)], pa.binary())],
                    names=["doc_id", "tag", "n", "cls", "bands", "sk"],
                )

    return _rows(docs).mapInArrow(work, "doc_id long, tag long, n long, cls binary, bands array<long>, sk binary")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _verify(size: int):
    """Over rows (p, part, role, cls, text) sorted by p, part, role: the pivot first, then those to compare."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, mine = None, None
        for batch in batches:
            for part, data, at in flat.slices(batch):
                sets = shingle_sets(data, at, size)
                a, b, both, union = [], [], [], []
                for s, role, cls in zip(sets, part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if role == 0:
                        pivot, mine = cls, s
                        continue
                    k = _overlap(mine, s)
                    a.append(pivot), b.append(cls), both.append(k), union.append(len(mine) + len(s) - k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(both, pa.int64()), pa.array(union, pa.int64())],
                    names=["a", "b", "both", "union"],
                )

    return work


def _near(x: np.ndarray, y: np.ndarray, rx: list, ry: list, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which rows (sketch, root, set size) of two sides may be linked and are not yet connected."""
    roots = {r: k for k, r in enumerate({*rx, *ry})}
    near = (x[:, None, :] == y[None, :, :]).sum(axis=2) >= least_agreeing(percent)
    near &= np.array([roots[r] for r in rx])[:, None] != np.array([roots[r] for r in ry])[None, :]
    return near & (100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :]))


def _partnered(percent: int):
    """Over rows (p, i, j, side, cls, root, sk, n) sorted by p, i, j: the rows that have a partner on the other side of their block."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> pa.Table:
            side, root, n = rows["side"].to_numpy(), rows["root"].to_pylist(), rows["n"].to_numpy()
            sk = np.frombuffer(b"".join(rows["sk"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = _near(sk[left], sk[right], [root[k] for k in left], [root[k] for k in right], n[left], n[right], percent)
            return rows.take(np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]]))

        def blocks(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """The whole blocks of rows, and what may go on in the next batch."""
            key = list(zip(rows["p"].to_pylist(), rows["i"].to_pylist(), rows["j"].to_pylist(), strict=True))
            edge = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            whole = [rows.slice(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]
            return (whole, rows.slice(0, 0)) if last or not whole else (whole[:-1], whole[-1])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            whole, rest = blocks(rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks(), False)
            for part in whole:
                yield from emit(part).to_batches()
        for part in blocks(rest, True)[0] if rest is not None else []:
            yield from emit(part).to_batches()

    return work


def _blocks(size: int, percent: int):
    """Over rows (p, i, j, side, cls, root, sk, text) sorted by p, i, j: links between the open classes (side 0) and all (side 1) of two blocks."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def emit() -> pa.RecordBatch:
            a, b = [], []
            left, right = sides
            if left and right:
                x, y = (np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COORDINATES) for rows in sides)
                nx, ny = (np.array([len(r[3]) for r in rows]) for rows in sides)
                near = _near(x, y, [r[1] for r in left], [r[1] for r in right], nx, ny, percent)
                for i, j in zip(*np.nonzero(near), strict=True):
                    k = _overlap(left[i][3], right[j][3])
                    if 100 * k >= percent * (len(left[i][3]) + len(right[j][3]) - k):
                        a.append(left[i][0]), b.append(right[j][0])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for part, data, at in flat.slices(batch):
                sets = shingle_sets(data, at, size)
                cols = {f.name: part.column(k).to_pylist() for k, f in enumerate(part.schema) if f.name != "text"}
                for k, s in enumerate(sets):
                    group = (cols["p"][k], cols["i"][k], cols["j"][k])
                    if group != now:
                        yield emit()
                        now, sides = group, ([], [])
                    sides[cols["side"][k]].append((cols["cls"][k], cols["root"][k], cols["sk"][k], s))
        yield emit()

    return work


def near_groups(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), n_shingles, component_id, kept, and class_id, the digest of the set."""
    scratch, parts = Scratch(spark, "near"), partitions(spark)
    far = 1 - percent / 100
    sig = scratch.keep(signatures(docs, shingle), "sig")
    classes = sig.filter("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "tag")).alias("rep"), F.first("bands").alias("bands"), F.first("sk").alias("sk"), F.first("n").alias("n")
    )
    classes = scratch.keep(classes, "classes")
    slots = classes.select("cls", F.explode("bands").alias("key"))
    shared = scratch.keep(slots.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "shared", few=True)
    members = scratch.keep(slots.join(shared, "key"), "members")
    # pairs: all of a small band, and each class of a large one with its pivot; a class has 32 bands at most to sum over
    meets = F.sum("held").over(Window.partitionBy("cls"))
    large = members.withColumn("meets", meets).filter(f"held > {ALL_PAIRS}").select("key", "cls", "meets")
    large = scratch.keep(large, "large", few=True)
    pivots = scratch.keep(large.groupBy("key").agg(F.max(F.struct("meets", "cls"))["cls"].alias("p")), "pivots", few=True)
    family = scratch.keep(large.join(pivots, "key").select("p", "cls").distinct(), "family", few=True)
    small = members.filter(f"held <= {ALL_PAIRS}").select("key", "cls")
    pairs = small.alias("x").join(small.alias("y"), "key").filter("x.cls < y.cls").select(F.col("x.cls").alias("p"), F.col("y.cls").alias("m"))
    pairs = scratch.keep(pairs.union(family.filter("p != cls").select("p", F.col("cls").alias("m"))).distinct(), "pairs", few=True)
    scratch.drop("members", "large", "pivots")
    least = least_agreeing(percent)

    def agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("ps", "ms"))
            yield b.select(["p", "m"]).filter(pa.array((x == y).sum(axis=1) >= least))

    sketches = classes.select("cls", "sk", "n")
    both = pairs.join(classes.select(F.col("cls").alias("m"), F.col("sk").alias("ms")), "m").join(classes.select(F.col("cls").alias("p"), F.col("sk").alias("ps")), "p")
    chosen = scratch.keep(both.select("p", "m", "ps", "ms").mapInArrow(agreeing, "p binary, m binary"), "chosen")

    # texts of one row of each class that is compared
    named = chosen.select(F.explode(F.array("p", "m")).alias("cls")).union(family.select("cls")).distinct()
    reps, rows = classes.join(named, "cls").select("cls", "rep.doc_id", "rep.tag"), _rows(docs)
    texts = scratch.keep(rows.join(reps, rows["doc_id"].eqNullSafe(reps["doc_id"]) & (rows["tag"] == reps["tag"])).select("cls", "text"), "texts")
    if texts.count() > texts.select("cls").distinct().count():
        texts = scratch.keep(texts.dropDuplicates(["cls"]), "texts-once")

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, both, union) of pairs(p, m), from full sets: a pivot's text goes to one group per BLOCK partners, a partner's once."""
        uses = scratch.keep(pairs.groupBy("p").agg(F.count("*").alias("uses")), f"{name}-uses", few=True)
        dealt = pairs.join(uses, "p").withColumn("part", F.pmod(F.xxhash64("m"), F.ceil(F.col("uses") / BLOCK)))
        wanted = dealt.select("p", "part", F.lit(0).alias("role"), F.col("p").alias("cls")).distinct().union(dealt.select("p", "part", F.lit(1), F.col("m")))
        rows = wanted.join(texts, "cls").select("role", "cls", "text", "p", "part").repartition(parts, "p", "part").sortWithinPartitions("p", "part", "role")
        return scratch.keep(rows.mapInArrow(_verify(shingle), "a binary, b binary, both long, union long"), name)

    compared = measured(chosen, "compared")
    links = compared.filter(f"100 * both >= {percent} * union").select("a", "b")
    roots = components(scratch, links, "cc-pivots")

    # what pivots leave open
    d = (1 - F.col("both") / F.col("union")).alias("d")

    def distances(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("p"), F.col("b").alias("cls"), d)

    state = (
        family.join(distances(compared), ["p", "cls"], "left").withColumn("d", F.when(F.col("p") == F.col("cls"), 0.0).otherwise(F.col("d")))
        .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    )
    state = scratch.keep(state, "state", few=True)
    base = scratch.keep(state.filter("p = cls").select("p", F.col("root").alias("base")), "base", few=True)
    away = scratch.keep(state.join(base, "p").filter("root != base").select("p", "cls", "d"), "away", few=True)
    unknown = away.filter("d is null").select("p", F.col("cls").alias("m"))
    if not unknown.isEmpty():
        away = away.filter("d is not null").unionByName(distances(measured(unknown, "compared-open")))
    nearest = away.groupBy("p").agg(F.min("d").alias("nearest"), F.count("*").alias("open"))
    nearest = scratch.keep(nearest.join(base, "p"), "nearest", few=True)
    if not nearest.isEmpty():
        left = state.join(nearest, "p").withColumn("side", (F.col("root") == F.col("base")).cast("int")).filter(
            (F.col("p") != F.col("cls")) & ((F.col("side") == 0) | (F.coalesce("d", F.lit(1.0)) >= F.col("nearest") - far - 1e-9))
        )
        left = scratch.keep(left.select("p", "cls", "root", "open", "side"), "open", few=True)
        left = left.join(sketches, "cls")
        mine = F.when(F.col("side") == 0, F.col("n"))
        many = left.groupBy("p").agg(F.count("*").alias("every"), F.sum("n").alias("shingles"), F.sum(mine).alias("open_shingles"))
        left = left.join(scratch.keep(many, "many", few=True), "p")
        own, all_ = (F.ceil(F.greatest(F.col(k) / OPEN_BLOCK, F.col(m) / OPEN_SHINGLES)).cast("int") for k, m in (("open", "open_shingles"), ("every", "shingles")))
        i, j = F.pmod(F.xxhash64("cls"), own).cast("int"), F.pmod(F.xxhash64("cls"), all_).cast("int")
        columns = ["cls", "root", "sk", "n"]
        # an open class stands in its own block on side 0, facing every block of side 1, and on side 1 as all others do
        sides = left.filter("side = 0").select("p", i.alias("i"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("j"), F.lit(0).alias("side"), *columns).union(
            left.select("p", F.explode(F.sequence(F.lit(0), own - 1)).alias("i"), j.alias("j"), F.lit(1), *columns)
        )
        schema = "p binary, i int, j int, side int, cls binary, root binary, sk binary, n long"
        sides = sides.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_partnered(percent), schema)
        sides = scratch.keep(sides, "partnered").drop("n").join(texts.hint("merge"), "cls")
        found = sides.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_blocks(shingle, percent), "a binary, b binary")
        found = scratch.keep(found.distinct(), "block-links")
        if not found.isEmpty():
            # components of components: only roots are joined anew
            joined = found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            merged = components(scratch, joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "cc-blocks")
            merged = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
            known = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            alone = merged.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
            roots = scratch.keep(known.union(alone), "roots", few=True)
    final = classes.select("cls", "least_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    final = scratch.keep(final, "final", few=True)
    least = scratch.keep(final.groupBy("root").agg(F.min("least_id").alias("component_id")), "least", few=True)
    resolved = scratch.keep(final.join(least, "root").select("cls", "component_id"), "resolved", few=True)
    out = sig.filter("cls is not null").select("doc_id", "tag", "n", "cls").join(resolved, "cls").select("doc_id", "tag", "n", "cls", "component_id")
    none = sig.filter("cls is null").select("doc_id", "tag", "n", "cls", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tag", F.col("cls").alias("class_id")
    )


def one_per_group(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat the kept id, all of its component stay but exact repeats."""
    scratch = Scratch(spark, "near-kept")
    of, own, times, mine, other = unused(docs, "of", "own", "times", "mine", "other")
    kept = near_groups(spark, docs, shingle, percent).filter("kept").groupBy(F.col("doc_id").alias(of), F.col("tag").alias(own)).agg(F.count("*").alias(times))
    kept = scratch.keep(kept, "kept", few=True)
    tagged = docs.withColumns({mine: F.xxhash64(F.col("text").cast("string")), other: F.col("doc_id").cast("long")})
    out = tagged.join(kept, F.col(other).eqNullSafe(F.col(of)) & (F.col(mine) == F.col(own)), "left_semi")
    if not kept.filter(F.col(times) > 1).isEmpty():
        out = out.dropDuplicates([other, mine])
    return out.select(*(named(c) for c in docs.columns))
