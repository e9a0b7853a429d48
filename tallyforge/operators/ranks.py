"""Exact ranks and medians of large groups.

Values are counted by distinct value and cut into ranges at a few hundred
approximate quantiles, which are all that reaches the driver. A range's rows are
then added up in one task and start from what the ranges below it hold, so no
task sees a whole group, however large.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200
#: Rows that a task keeps of all groups together before it passes them on.
_KEPT = 500_000


def cumulative(df: DataFrame, by: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(by, value, n, end, whole): rows with each value, rows up to it, and rows of the group. Null values are left out."""
    present = df.where(F.col(value).isNotNull())
    cuts = present.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()["cuts"]
    literal = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    range_of = F.size(F.filter(literal, lambda c: c < F.col(value)))
    counts = present.groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("_range", range_of)
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_in"))  # a few hundred rows a group
    starts = totals.select(*by, "_range", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_start"), F.sum("_in").over(Window.partitionBy(*by)).alias("whole"))
    same = F.col("c._range") == F.col("s._range")
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    placed = counts.alias("c").join(starts.alias("s"), same).select(*[F.col(f"c.{c}").alias(c) for c in [*by, value, "n", "_range"]], "_start", "whole")
    running = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy(value))
    return placed.select(*by, value, "n", (F.col("_start") + running).alias("end"), "whole")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over ``cumulative``: the value at a rank counted from 0."""
    return F.min(F.when(F.col("end") > rank, F.col(value)))


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the middle two. A group without values has no row."""
    middle = (F.col("whole") - 1) / 2
    ends = cumulative(df, by, value).groupBy(*by).agg(at_rank(value, F.floor(middle)).alias("_low"), at_rank(value, F.ceil(middle)).alias("_high"))
    return ends.select(*by, (F.col("_low") * 0.5 + F.col("_high") * 0.5).alias("median"))


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group in ``order`` (ascending; nulls are the oldest), whole groups where they have fewer.

    Partial, then merged: a task keeps the last ``n`` of each group that it meets
    and passes on no others, so what is shuffled grows with groups and tasks, not
    with rows, and a group with most of the rows costs no more than another. A
    task that meets very many groups passes on what it has and starts again.
    ``order`` should tell rows apart; a null group is a group.
    """
    columns = df.columns

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = both.sort_values(list(order), ascending=False, na_position="last", kind="stable").groupby(list(by), dropna=False, sort=False).head(n)
            held = last
            if len(held) > _KEPT:
                yield held[columns]
                held = None
        if held is not None:
            yield held[columns]

    last = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.mapInPandas(keep, df.schema).withColumn("_last", F.row_number().over(last)).where(F.col("_last") <= n).drop("_last")
