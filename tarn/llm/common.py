"""Scratch tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1 / HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Partitions that go to one file where rows are small.
FILES_SHARE = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where that is unset and all runs on one machine, as in tests, a temporary folder is made and set.  On a
    cluster it has to be set: a folder of the driver's own is none that executors see.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: The scratch folders made inside each released() that is open, the innermost last.
_open: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Deletes on leaving what operators called inside have kept: for callers that have written the results by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch._end()


class Scratch:
    """Tables of one run of an operator, each in its own folder below shared_dir().

    keep() cuts the lineage by writing Parquet: a lost executor costs no recomputation of what is written.
    drop() frees a table that later steps no longer read.  What an operator returns still reads its last
    tables; they go when the innermost released() around the call ends, else when the interpreter does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if _open:
            _open[-1].append(self)
        else:
            atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass

    def keep(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """Write a table and read it back; few: rows are small, so that a task writes what FILES_SHARE of them would."""
        at = f"{self.path}/{name}"
        if few:
            df = df.coalesce(max(8, partitions(self.spark) // FILES_SHARE))
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(name: str) -> Column:
    """The column with exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns, the wanted ones with as many underscores added as it takes for df to have none like them."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to a type, or null where the table lacks it."""
    return (named(name) if name in df.columns else F.lit(None)).cast(kind)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one group row per key; `count` in groups is the number of rows of the key.

    A key with more than 1/1000 of all rows is hot.  There are fewer than 1000 hot groups, whatever the
    data, so these are broadcast; all other keys are small enough for a shuffled join, and are never broadcast.
    """
    limit = max(1000, math.ceil(total / HOT_SHARE))
    hot = groups.filter(F.col(count) > limit)
    cold = groups.filter(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    )


def input_bytes(df: DataFrame) -> int:
    """The size of what a DataFrame reads, from file sizes where Spark knows them, else by summing its texts."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    return int(df.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
