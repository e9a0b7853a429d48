"""Evaluation against labels that are independent of the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import ranks
from tallyforge.operators.reports import ratio


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts by (expected, predicted); rows without a label are not scored."""
    return df.where(F.col(expected).isNotNull()).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def top_confusions(counts: DataFrame, limit: int = 25) -> DataFrame:
    """The pairs that differ, the most frequent first.

    Hits sort last and go after the limit: a filter before it would be moved below
    the counting, where both labels are worked out from a row's texts once more.
    """
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    return counts.orderBy(hit, F.col("n").desc(), "expected", "predicted").limit(limit).where(~hit)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of a rate k / n; 0 and 0 for n = 0."""
    p, n = ratio(k, n), n.cast("double")
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Per class: support, predicted, correct, precision, recall and F1, from a confusion table."""
    sides = counts.select(F.col("expected").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("c")).unionByName(
        counts.where("predicted is not null").select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("c"))
    )
    rows = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("c").alias("correct"))
    return rows.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", ratio(F.col("correct"), F.col("support"))).withColumn("f1", ratio(2 * F.col("correct"), F.col("support") + F.col("predicted")))


def nearest_rank(df: DataFrame, by: str, value: str, percents: tuple[float, ...]) -> DataFrame:
    """Per group the values at rank round(p * (n - 1)), halves to even, counted from 0.

    A group without values has no row.
    """
    picks = [ranks.at_rank(value, F.bround(F.lit(p) * (F.col("whole") - 1), 0)).alias(f"p{round(p * 100)}") for p in percents]
    return ranks.cumulative(df, [by], value).groupBy(by).agg(F.max("whole").alias("n"), *picks)


def recent_nearest_rank(df: DataFrame, by: str, value: str, order: list[str], percents: tuple[float, ...], last: int = 2000) -> DataFrame:
    """``nearest_rank`` over the ``last`` samples of each group in ``order``; samples without a value are none."""
    samples = df.where(F.col(value).isNotNull()).select(by, value, *[c for c in order if c not in (by, value)])
    return nearest_rank(ranks.newest(samples, [by], order, last), by, value, percents)


def scored(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: rows scored, correct, accuracy and its interval."""
    labelled = df.where(F.col(expected).isNotNull())
    row = labelled.agg(F.count("*").alias("scored"), F.count_if(F.col(expected) == F.col(predicted)).alias("correct"))
    return row.withColumn("accuracy", ratio(F.col("correct"), F.col("scored"))).withColumn("interval", wilson(F.col("correct"), F.col("scored"))).select("scored", "correct", "accuracy", F.col("interval.low").alias("low"), F.col("interval.high").alias("high"))


def scoring_set(labels: DataFrame, tickets: DataFrame, classifications: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labelled tickets with their classification, and those that have none; the latter are listed, not scored."""
    known = labels.join(tickets.select(key), key, "left_semi")
    return known.join(classifications, key), known.join(classifications.select(key), key, "left_anti")


def strata(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n"))


def first_per_bucket(df: DataFrame, bucket: str, order: list[str], n: int = 4) -> DataFrame:
    """The first ``n`` rows of each bucket; Spark's group limit drops the others before the shuffle."""
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("pick") <= n)


def latest_run(df: DataFrame, run: str, created: str) -> DataFrame:
    """The rows of the run that was created last; of equals the one whose id sorts last."""
    newest = df.agg(F.max(F.struct(created, run))[run].alias(run))
    return df.join(newest, run, "left_semi")


def top_probabilities(probabilities: Column, n: int = 4) -> Column:
    """The ``n`` likeliest entries of a map, as an array of (key, value), equals by key."""
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def rates(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of rates by name, (rows that hit) over (rows that count); null where none counts."""
    return df.agg(*[ratio(F.count_if(hit & base), F.count_if(base)).alias(name) for name, (hit, base) in pairs.items()])
