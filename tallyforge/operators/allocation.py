"""Sequential allocation, ranked sampling."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def allocate_excess(df: DataFrame, group: str, amount: str, cap: Column, order: list[str]) -> DataFrame:
    """What of each row exceeds its group's cap, taken from the second row on in ``order``.

    Adds n_in_group, group_total, group_excess and excess. A row takes what is
    left of the excess after the rows before it, but not of the first. A cap
    that is null or zero gives no excess, nor does a group of one. Groups are
    the refunds of one order: few rows, so a window over them is small.
    """
    whole, running = Window.partitionBy(group), Window.partitionBy(group).orderBy(*order)
    prior = F.coalesce(F.sum(amount).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lead = F.first(amount).over(running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    over = F.greatest(F.lit(0.0), F.col("group_total") - F.col("_cap"))
    return (
        df.withColumn("_cap", cap)
        .withColumn("n_in_group", F.count("*").over(whole))
        .withColumn("group_total", F.sum(amount).over(whole))
        .withColumn("group_excess", F.when((F.col("n_in_group") > 1) & (F.coalesce("_cap", F.lit(0.0)) != 0), over).otherwise(0.0))
        .withColumn("_rank", F.row_number().over(running))
        .withColumn("excess", F.when(F.col("_rank") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.col(amount), F.col("group_excess") - (prior - lead)))))
        .drop("_cap", "_rank")
    )


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows, the best of every stratum first, then the second of each, and so on.

    No row beyond the n-th of its stratum can be drawn; Spark's group limit drops
    those before the shuffle.
    """
    ranked = df.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("pick") <= n)
    return ranked.orderBy("pick", stratum).limit(n)


def stratified_hash_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum, by a seeded hash of ``key``: the same rows on every run."""
    draw = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return df.withColumn("pick", F.row_number().over(draw)).where(F.col("pick") <= per_stratum)


def union_distinct(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the parts, a key only once, from the first part that has it, there the one whose other columns are smallest.

    Spark keeps a key's first row in each task before rows are shuffled, so a key
    that most rows have costs no more than another.
    """
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    rest = [c for c in parts[0].columns if c != key]
    first = Window.partitionBy(key).orderBy("_part", *rest)
    return out.withColumn("_first", F.row_number().over(first)).where("_first = 1").select(key, *rest)


def leftover(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


@dataclass
class Page:
    """Rows of a page, how many rows there are in all, and where the next page begins (null: there is none)."""

    rows: DataFrame
    total: int
    after: tuple[Any, ...] | None


def seek(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple[Any, ...] | None = None) -> Page:
    """The ``limit`` rows that follow the key ``after``, and the number of all rows, from one pass.

    ``order``: (column, descending); nulls come last; the columns together should
    tell rows apart. ``after``: their values in the last row of the page before.
    However deep the page, each task keeps ``limit`` rows at most and nothing is
    sorted but those; the rows are counted as they pass.
    """
    columns = [c for c, _ in order]
    beyond, same = F.lit(False), F.lit(True)
    for (c, down), value in zip(order, after or ()):
        own = F.lit(False) if value is None else (F.col(c) < F.lit(value) if down else F.col(c) > F.lit(value)) | F.col(c).isNull()
        beyond, same = beyond | (same & F.coalesce(own, F.lit(False))), same & F.col(c).eqNullSafe(F.lit(value))
    told = Observation()
    passed = df.observe(told, F.count(F.lit(1)).alias("n"))
    wanted = passed.where(beyond) if after else passed
    found = wanted.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]).limit(limit).collect()  # a page
    total = told.get["n"] if found or not df.isEmpty() else 0
    rows = df.sparkSession.createDataFrame(found, df.schema)
    return Page(rows, total, tuple(found[-1][c] for c in columns) if len(found) == limit else None)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
