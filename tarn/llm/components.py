"""Connected components of an edge table, by least labels and pointer jumping.

Labels and edges stay distributed; each step is cut by a written table.  Both sides of a join are such
tables and nothing but a sort stands between them and the join, so Spark can split the partition of a node
with very many edges (adaptive skew joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for all nodes of edges(a, b); root is the least node of the component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, f"{name}-edges", few=True)
    first = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
    labels = scratch.keep(first, f"{name}-0", few=True)
    step = 0
    while True:
        step += 1
        offered = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        lower = scratch.keep(lower, f"{name}-{step}-low", few=True)
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = scratch.keep(lower.join(jump, "root").select("node", "was", F.col("next").alias("root")), f"{name}-{step}", few=True)
        changed = not jumped.filter("root != was").isEmpty()
        scratch.drop(f"{name}-{step}-low", f"{name}-{step - 1}")
        labels = jumped.drop("was")
        if not changed:
            return labels
