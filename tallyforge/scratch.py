"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be sent to every executor.
BROADCAST_ROWS = 200_000
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def beside(df: DataFrame) -> DataFrame:
    """A saved table of narrow rows, for the small side of a join: broadcast if it is counted as small, else left to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, which only a local session may leave it, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def path_of(spark: SparkSession, name: str):
    """A Hadoop path and its file system, whatever store it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one run, under a folder of its own that goes at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table as written; what was shuffled for it goes at once, not whenever the driver happens to collect its garbage."""
        schema, path = df.schema, f"{self.path}/{name}"
        before = self.spark.conf.get(_TIDY)
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path, store = path_of(self.spark, f"{self.path}/{name}" if name else self.path)
        store.delete(path, True)

    def clear(self) -> None:
        """At exit, when no result can be read any more; the session may be gone by then."""
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # noqa: BLE001
                return
