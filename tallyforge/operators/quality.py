"""Measuring and repairing data quality: duplicates, money units, references, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import ranks

#: Order of findings in a ledger.
SEVERITIES = ("critical", "high", "medium", "info")


def dedupe_by_preference(df: DataFrame, keys: Sequence[str], order: Sequence[Column], variant: str | None = None) -> DataFrame:
    """One row per key, the first in ``order``, with ``duplicate_row_count`` and, for ``variant``, its sorted distinct values.

    The best row is an aggregate that combines before the shuffle, so a key that
    holds a large part of the rows does not pile up in one task; as rows are not
    fixed-width values, it is one by sorting, in the tasks before the shuffle and
    after. ``order`` should break every tie; descending sorts are written as
    negated columns.
    """
    rest = [c for c in df.columns if c not in keys]
    extra = [F.sort_array(F.collect_set(variant)).alias(f"{variant}_variants")] if variant else []
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row"),
        F.count("*").alias("duplicate_row_count"),
        *extra,
    )
    return best.select(*keys, "_row.*", "duplicate_row_count", *[f"{variant}_variants"] * bool(variant))


def detect_unit(df: DataFrame, key: str, system: str, amount: str, base: str, other: str) -> DataFrame:
    """One row: whether amounts of system ``other`` are a fixed whole multiple of those of ``base`` for the same key.

    Pairs need both amounts and a positive base amount. Conclusive only if the
    ratios, rounded to six places, are one single whole number above 1; otherwise
    the divisor is 1 and the finding critical.
    """
    value = lambda s: F.max(F.when(F.col(system) == s, F.col(amount)))
    pairs = df.groupBy(key).agg(value(base).alias("b"), value(other).alias("o")).where("b > 0 and o is not null")
    ratios = pairs.groupBy(F.round(F.col("o") / F.col("b"), 6).alias("ratio")).agg(F.count("*").alias("n"))
    found = ratios.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("ratios"), F.min("ratio").alias("ratio"))
    conclusive = F.coalesce((F.col("ratios") == 1) & (F.col("ratio") > 1) & (F.col("ratio") == F.floor("ratio")), F.lit(False))
    return found.select(
        "pairs",
        F.col("ratios").alias("distinct_ratios"),
        conclusive.alias("conclusive"),
        F.when(conclusive, F.col("ratio").cast("long")).otherwise(F.lit(1).cast("long")).alias("divisor"),
        F.when(conclusive, "info").otherwise("critical").alias("severity"),
    )


def convert_unit(df: DataFrame, amount: str, system: str, other: str, divisor: int) -> DataFrame:
    """``amount`` in the base unit, with the source value, a flag and the divisor kept beside it."""
    converted = (F.col(system) == other) & F.col(amount).isNotNull() & F.lit(divisor > 1)
    return (
        df.withColumn(f"{amount}_source", F.col(amount))
        .withColumn("unit_converted", F.coalesce(converted, F.lit(False)))
        .withColumn("unit_divisor", F.when(F.col("unit_converted"), divisor).otherwise(1).cast("long"))
        .withColumn(amount, F.when(F.col("unit_converted"), F.col(amount) / divisor).otherwise(F.col(amount)))
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent; a null key is an orphan."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def integrity(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """A row per check (name, child, key, parent, parent key): orphans and surplus parent keys."""
    rows = []
    for name, child, key, parent, parent_key in checks:
        lost = orphans(child, key, parent, parent_key).agg(F.count("*").alias("orphans"))
        twice = parent.agg((F.count(parent_key) - F.countDistinct(parent_key)).alias("duplicate_keys"))
        rows.append(lost.crossJoin(twice).select(F.lit(name).alias("check_name"), "orphans", "duplicate_keys"))  # one row each
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def mismatched_link(child: DataFrame, link: str, own: str, parent: DataFrame, parent_key: str, parent_value: str) -> DataFrame:
    """Rows whose linked parent states another value than their own; a link without a parent is a mismatch too."""
    stated = parent.select(F.col(parent_key).alias(link), F.col(parent_value).alias("_stated"))
    return child.where(F.col(link).isNotNull()).join(stated, link, "left").where(~F.col("_stated").eqNullSafe(F.col(own))).drop("_stated")


def flags(conditions: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]))


def timestamp_assessment(df: DataFrame, system: str, started: str, ended: str, tested: str, shift_hours: float = 5.5, least: float = -3.0) -> DataFrame:
    """One row: per-system medians of hours, negatives, and whether shifting ``tested`` would make its median implausible.

    Conclusive, so that nothing is shifted, if there are negative durations or the
    shifted median is below ``least``; a system without rows proves nothing.
    """
    hours = (F.unix_timestamp(F.col(ended).cast("timestamp")) - F.unix_timestamp(F.col(started).cast("timestamp"))) / 3600.0
    rows = df.select((F.col(system) == tested).alias("tested"), hours.alias("h"))
    middle = ranks.medians(rows.where("tested is not null"), ["tested"], "h").agg(  # one row
        F.max(F.when(F.col("tested"), F.col("median"))).alias("median_tested"), F.max(F.when(~F.col("tested"), F.col("median"))).alias("median_others")
    )
    return rows.agg(F.count_if(F.col("h") < 0).alias("negative_rows")).crossJoin(middle).withColumn("conclusive", F.coalesce((F.col("negative_rows") > 0) | (F.col("median_tested") - shift_hours < least), F.lit(False)))


#: Hours by which a time in UTC lies behind the desk's own.
UTC_SHIFT = -5.5


def timestamp_shift(df: DataFrame, system: str, started: str, ended: str, tested: str, least: float = -3.0) -> DataFrame:
    """One row: medians of hours of ``tested`` and of the other systems, their difference, and whether that shows a shift.

    Conclusive if there are negative durations, or ``tested`` lies more than
    ``least`` hours apart. A system without durations proves nothing.
    """
    hours = (F.unix_timestamp(F.col(ended).cast("timestamp")) - F.unix_timestamp(F.col(started).cast("timestamp"))) / 3600.0
    rows = df.select((F.col(system) == tested).alias("tested"), hours.alias("h"))
    side = lambda t: F.max(F.when(F.col("tested") == F.lit(t), F.col("median")))
    middle = ranks.medians(rows.where("tested is not null"), ["tested"], "h").agg(side(True).alias("median_tested"), side(False).alias("median_others"))
    wide = rows.agg(F.count_if(F.col("h") < 0).alias("negative_rows")).crossJoin(middle)  # one row each
    shift = F.col("median_tested") - F.col("median_others")
    return wide.withColumn("shift", shift).withColumn("conclusive", F.coalesce((F.col("negative_rows") > 0) | (F.col("shift") < least), F.col("negative_rows") > 0))


def corroborate_unit(df: DataFrame, key: str, system: str, amount: str, base: str, other: str, divisor: int, listed: int = 10) -> DataFrame:
    """One row beside ``detect_unit``: what else speaks for the divisor.

    The ratios found, smallest first (``listed`` at most); whether every amount
    of ``other`` divides; both systems' medians, the other one converted, and how
    they agree. all_divisible, converted_median and agreement are null where the
    divisor is 1, that is where nothing was found.
    """
    value = lambda s: F.max(F.when(F.col(system) == s, F.col(amount)))
    pairs = df.groupBy(key).agg(value(base).alias("b"), value(other).alias("o")).where("b > 0 and o is not null")
    ratios = pairs.select(F.round(F.col("o") / F.col("b"), 6).alias("ratio")).distinct().orderBy("ratio").limit(listed).agg(F.sort_array(F.collect_list("ratio")).alias("ratios"))
    medians = ranks.medians(df.where(F.col(system).isin(base, other)), [system], amount)
    side = lambda s, name: F.max(F.when(F.col(system) == s, F.col("median"))).alias(name)
    middle = medians.agg(side(other, "legacy_median"), side(base, "base_median"))
    divides = df.agg(F.coalesce(F.bool_and(F.when((F.col(system) == other) & F.col(amount).isNotNull(), F.col(amount) % divisor == 0)), F.lit(True)).alias("divides"))
    found = F.lit(divisor > 1)
    wide = ratios.crossJoin(middle).crossJoin(divides)  # one row each
    converted = F.col("legacy_median") / divisor
    return wide.select(
        "ratios", F.when(found, F.col("divides")).alias("all_divisible"), "legacy_median", "base_median",
        F.when(found, F.round(converted, 2)).alias("converted_median"), F.when(found, F.round(F.try_divide(converted, F.col("base_median")), 4)).alias("agreement"),
    )


def ledger(findings: DataFrame) -> DataFrame:
    """Findings (finding_id, severity, ...) by severity, then id."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    return findings.orderBy(rank, "finding_id")
