"""Intermediate tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table and reading it again:
a lost executor then costs a re-read, never a recomputation of earlier rounds,
and the file sizes let Spark choose a broadcast where a side is small.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tallyforge.scratch import Scratch, beside, shared_folder

__all__ = ["Scratch", "batches", "beside", "fresh", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in a batch that goes to Python, for what is run within: whole texts at the usual 10,000 rows take hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its own are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
