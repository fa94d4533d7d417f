"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source.  A source whose target holds its whole size q times takes
every document q times; the rest of its budget is fitted by a subset: first the same share of every length,
then single documents in seeded order until little is left, and for that a bounded-knapsack dynamic
programme over the lengths still free.  The plan says how many documents of each length are taken, and the
seeded hash order of the documents of that length says which.

The driver sees one row per source, and sends targets out as a table that is joined.  A histogram of lengths
is solved per source in one task: its rows are distinct lengths, not documents.  Documents of a common length are ranked in hash buckets of about 10,000
rows, so a length that a third of all rows share is no hot group.

Defined results: null or blank text has size 0 and is taken 0 times; null is a source of its own, the last
in order; rows that repeat a doc_id are separate documents; an empty table gives an empty result; a source
of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.common import Scratch, column_or_null, join_hot, named, unused

WEIGHTS = (3, 1, 2)
#: Words of a source's budget that are left to the dynamic programme, at least.
FINE_WORDS = 1 << 16
BUCKET_ROWS = 10_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Each source's target: by weight, no more than `most` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, Fraction] = {}
    free, left = [s for s, _ in order], Fraction(share) * sum(size.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = Fraction(most * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each distinct length > 0 to take, so that the lengths sum to budget or as near as can be.

    Exact whenever the dynamic programme over what the first two steps leave free reaches the budget.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(flat.mix64(lengths.astype(np.uint64)), kind="stable")
    moved = True
    while left > FINE_WORDS and moved:
        moved = False
        for i in order:
            if take[i] < counts[i] and lengths[i] <= left - FINE_WORDS:
                take[i] += 1
                left -= int(lengths[i])
                moved = True
    # sums beyond what is left count too, as far as nothing at all would be: the nearest sum wins
    most = 2 * left
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    by = np.full(most + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for i in order:
        free, part, w = int(min(counts[i] - take[i], most // lengths[i])), 1, int(lengths[i])
        while free > 0 and not reach[left]:
            part = min(part, free)
            step = w * part
            if step <= most:
                new = reach[: most + 1 - step] & ~reach[step:]
                by[step:][new] = len(pieces)
                reach[step:] |= new
            pieces.append((int(i), part))
            free, part = free - part, part * 2
        if reach[left]:
            break
    sums = np.flatnonzero(reach)
    s = int(sums[np.argmin(np.abs(sums - left))])
    while s:
        i, part = pieces[by[s]]
        take[i] += part
        s -= int(lengths[i]) * part
    return take


def word_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and `size`, the number of words of the whole text."""
    kept = docs.select(*columns)
    schema = kept.schema.fieldNames()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in flat.slices(batch):
                _, _, first = flat.spans(data, at)
                cols = [part.column(i) for i, f in enumerate(part.schema) if f.name != "text"]
                names = [f.name for f in part.schema if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first), pa.int64())], names=[*names, "size"])

    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([f for f in kept.schema.fields if f.name != "text"] + [StructField("size", LongType())])
    assert "text" in schema
    return kept.mapInArrow(count, out)


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share=Fraction(3, 2), most: int = 2, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken, and crc, the text's hash that tells repeated ids apart."""
    scratch = Scratch(spark, "mix")
    source = column_or_null(docs, "source", "string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("skey"),
        F.xxhash64(text).alias("crc"),
        text.alias("text"),
    )
    rows = scratch.keep(
        word_counts(rows, ["doc_id", "skey", "crc", "text"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "crc")),
        "rows",
    )
    sums = rows.groupBy("skey").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total = sum(r.n for r in sums)
    size = {r.skey: int(r.size) for r in sums}
    target = targets([(None if k == "n" else k[1:], s) for k, s in size.items()], weights, share, most)
    budgets = []
    for k, whole in size.items():
        wanted = target[None if k == "n" else k[1:]]
        times, rest = divmod(int(wanted + Fraction(1, 2)), whole) if whole else (0, 0)
        budgets.append((k, whole, float(wanted), times, rest if times < most else 0))
    schema = "skey string, source_size long, target double, times long, rest long"
    budgets = spark.createDataFrame(budgets, schema)

    def plan(rows: pa.Table) -> pa.Table:
        lengths, counts, rest = rows["size"].to_numpy(), rows["n"].to_numpy(), rows["rest"][0].as_py()
        extra = np.zeros(len(lengths), np.int64)
        if rest:
            full = lengths > 0
            extra[full] = fit(lengths[full], counts[full], rest)
        return rows.append_column("extra", pa.array(extra))

    hist = rows.groupBy("skey", "size").agg(F.count("*").alias("n")).join(budgets.hint("merge"), "skey")
    plans = hist.groupBy("skey").applyInArrow(plan, f"skey string, size long, n long, {schema.partition(', ')[2]}, extra long").drop("rest")
    plans = scratch.keep(plans, "plans", few=True)
    planned = scratch.keep(join_hot(rows, plans, ["skey", "size"], "n", total), "planned", few=True)
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    cut = planned.filter(split).withColumn(
        "bucket", F.pmod(F.shiftrightunsigned("h", 20), F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))
    )
    heads = cut.groupBy("skey", "size", "bucket").agg(F.count("*").alias("m"))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("skey", "size", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "size", "bucket").orderBy("h", "doc_id")
    ranked = (
        cut.withColumn("rank", F.row_number().over(inside))
        .join(heads.hint("merge"), ["skey", "size", "bucket"])
        .withColumn("one", (F.col("base") + F.col("rank") <= F.col("extra")).cast("long"))
    )
    rest = planned.filter(~split).withColumn("one", (F.col("extra") > 0).cast("long"))
    out = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("one"))).alias("taken")]
    more = ["crc", (F.col("times") + F.col("one")).alias("copies")]
    return ranked.select(*out, *more).unionByName(rest.select(*out, *more))


def apply_mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, with all its columns.

    Documents of size 0 have nothing to give and are left out.  Of rows that repeat doc_id and text, each
    gets its own decision, in either order.
    """
    scratch = Scratch(spark, "mix-applied")
    of, own, times, every, mine, other, place, copy = unused(docs, "of", "own", "times", "every", "mine", "other", "place", "copy")
    copies = F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    decided = mix(spark, docs, **how).groupBy(F.col("doc_id").alias(of), F.col("crc").alias(own)).agg(copies.alias(every), F.count("*").alias(times))
    decided = scratch.keep(decided, "decided", few=True)
    tagged = docs.withColumns({mine: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), other: F.col("doc_id").cast("long")})
    joined = tagged.join(decided, F.col(other).eqNullSafe(F.col(of)) & (F.col(mine) == F.col(own))).filter(F.col(every) > 0)
    if not decided.filter(F.col(times) > 1).isEmpty():
        joined = joined.withColumn(place, F.row_number().over(Window.partitionBy(other, mine).orderBy(every)))
        each = F.floor(F.col(every) / F.col(times)) + (F.col(place) <= F.col(every) % F.col(times)).cast("int")
        joined = joined.withColumn(every, each).filter(F.col(every) > 0)
    joined = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(every).cast("int"))))
    return joined.select(*(named(c) for c in docs.columns))
