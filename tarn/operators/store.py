"""Intermediate tables and indexes in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.operators.index import Index


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _until_exit(spark: SparkSession, path: str) -> None:
    def end() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass

    atexit.register(end)


class Kept(list):
    """The folders of tables that one computation keeps; drop() frees them, and the interpreter's end does."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        at = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _until_exit(self.spark, at)
        df.write.options(**options).parquet(at)
        self.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, leave: int = 0) -> None:
        """Delete all but the last `leave` tables."""
        while len(self) > leave:
            remove(self.spark, self.pop(0))


def keep(spark: SparkSession, df: DataFrame, name: str, **options) -> DataFrame:
    return Kept(spark).table(df, name, **options)


_indexes: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, name: str, build: Callable[[], Index]) -> Index:
    """The index of this name, built and saved once in a session, in the shared folder, until the session's end."""
    key = (spark.sparkContext.applicationId, name)
    index = build()
    if key not in _indexes:
        at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}"
        _until_exit(spark, at)
        index.save(at)
        _indexes[key] = at
    return Index.load(index.docs, _indexes[key], index.stopwords, index.stem)
