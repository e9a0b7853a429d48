"""Repeat contacts: who comes back about the same issue after it was resolved.

An extension: the policy states the rule, and that the same customer and product
stand for the same issue; nothing published computes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.decisions import REPEAT_DAYS
from tallyforge.operators.reports import ratio

_DAY = 24 * 3600 * 1_000_000
#: Tickets of an issue that one task may hold; an issue with more is cut by day.
_BUSY = 1_000
#: Busy issues at most, and issues that a task's sketch remembers.
_BUSIEST, _TRACKED = 1_000, 4_000


def _moments(rows: DataFrame, key: Sequence[str], at: Column, changes: Sequence[tuple[Column, int]]) -> DataFrame:
    """Each row at its ``at``, where it asks, and each change at its moment, with only the key and a weight."""
    moment = lambda t, n, asked: F.struct(t.alias("t"), F.lit(n).cast("long").alias("n"), F.lit(asked).alias("asked"))
    each = rows.withColumn("_m", F.explode(F.array(moment(at, 0, True), *[moment(t, n, False) for t, n in changes]))).where("_m.asked or _m.t is not null")
    kept = [F.when(F.col("_m.asked"), F.col(c)).alias(c) for c in rows.columns if c not in key]
    return each.select(*key, *kept, F.col("_m.t").alias("_t"), F.col("_m.n").alias("_n"), F.col("_m.asked").alias("_asked"))


def _dealt(df: DataFrame, key: Sequence[str], times: int = 1) -> DataFrame:
    """By the key to so many times the shuffle partitions. Adaptive execution does not join these: their bytes are few for the rows that a task makes of them."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def counts_until(rows: DataFrame, key: Sequence[str], at: Column, changes: Sequence[tuple[Column, int]], name: str, by_day: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name`` (long): what the ``changes`` (moment, weight) of the key's rows add up to, up to and with the row's ``at``.

    Times are whole microseconds; a change without a moment counts nowhere. A row
    asks beside the changes, so nothing is joined back to it, and rows that are
    dealt by the key already are not shuffled again. ``by_day`` has the rows whose
    changes count, if the key's work is to be cut by day: a running sum within the
    day, and what the days before hold carried over their totals, so no task holds
    more of a key than a day, or one row a day.
    """
    each = _moments(rows, key, at, changes)
    upto = lambda *cut: Window.partitionBy(*key, *cut).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    if by_day is None:
        return each.withColumn(name, F.sum("_n").over(upto())).where("_asked").select(*rows.columns, name)
    dated = lambda df: df.withColumn("_day", F.expr(f"(_t - pmod(_t, {_DAY}L)) div {_DAY}L"))
    own = _dealt(dated(each), [*key, "_day"]).withColumn("_own", F.sum("_n").over(upto("_day"))).where("_asked")
    days = dated(_moments(by_day, key, at, changes)).groupBy(*key, "_day").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return own.join(carried, [*key, "_day"]).select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))


def busy_issues(tickets: DataFrame, issue: Sequence[str]) -> DataFrame:
    """``_issue``: hashes of the issues with more than ``_BUSY`` tickets, ``_BUSIEST`` at most. One that is left out has some thousandth of all tickets, or fewer."""
    hashed = f"xxhash64({', '.join(f'`{c}`' for c in issue)})"
    top = tickets.agg(F.expr(f"approx_top_k({hashed}, {_BUSIEST}, {_TRACKED})").alias("_top"))
    return top.select(F.inline("_top")).where(F.col("count") > _BUSY).select(F.col("item").alias("_issue"))


def repeat_contacts(tickets: DataFrame, issue: Sequence[str], created: str, resolved: str, days: int = REPEAT_DAYS) -> DataFrame:
    """``tickets`` with ``contacts_after`` and ``resolutions_before`` (long).

    contacts_after: other tickets of the issue that were created after this one
    was resolved, within ``days``; null while it is not resolved. Where it is 0,
    the first contact resolved the issue. resolutions_before: other tickets of
    the issue that were resolved within ``days`` before this one was created; any
    makes it a repeat contact. A ticket never counts for itself. A ticket without
    all parts of its issue, or its creation, stands alone. Both are sums up to a
    moment (``counts_until``): a creation counts for what is resolved in the
    ``days`` before it, a resolution for what is created in the ``days`` after it.
    So no tickets are paired. Tickets are dealt by their issue once, and only busy
    issues are cut by day.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    c, r, span = micros(created), micros(resolved), days * _DAY
    counted = reduce(and_, [F.col(k).isNotNull() for k in issue]) & (c.isNotNull() | r.isNotNull())
    known, alone = tickets.where(counted), tickets.where(~counted)
    busy = F.broadcast(busy_issues(known, issue))
    is_busy = F.xxhash64(*issue) == F.col("_issue")
    itself = lambda hit: F.coalesce(hit.cast("long"), F.lit(0))

    def told(rows: DataFrame, by_day: DataFrame | None = None) -> DataFrame:
        # A ticket without the time at which it would ask is told nothing; at its other time, as nulls would meet in one task.
        rows = counts_until(rows, issue, F.coalesce(r, c), [(c - span, 1), (c, -1)], "_after", by_day)
        rows = counts_until(rows, issue, F.coalesce(c - 1, r), [(r, 1), (r + span, -1)], "_before", by_day)
        after = F.when(r.isNotNull(), F.col("_after") - itself((c > r) & (c <= r + span)))
        before = F.when(c.isNotNull(), F.col("_before") - itself((r < c) & (r >= c - span))).otherwise(0)
        return rows.select(*tickets.columns, after.cast("long").alias("contacts_after"), before.cast("long").alias("resolutions_before"))

    quiet = _dealt(known.join(busy, is_busy, "left_anti"), issue, 2)  # a ticket is three rows after it
    often = known.join(busy, is_busy, "left_semi")
    none = alone.select(*tickets.columns, F.when(r.isNotNull(), 0).cast("long").alias("contacts_after"), F.lit(0).cast("long").alias("resolutions_before"))
    return told(quiet).unionByName(told(often, often)).unionByName(none)


def first_contact_resolution(told: DataFrame, attended: F.Column, cost: F.Column) -> DataFrame:
    """One row from ``repeat_contacts``: attended and resolved tickets, how many of them were resolved at first contact, the rate, repeat contacts and what these cost."""
    base = attended & F.col("contacts_after").isNotNull()
    repeat = F.col("resolutions_before") > 0
    row = told.agg(
        F.count_if(base).alias("resolved"),
        F.count_if(base & (F.col("contacts_after") == 0)).alias("first_contact"),
        F.count_if(repeat).alias("repeat_contacts"),
        F.coalesce(F.sum(F.when(repeat, cost).cast("decimal(18,4)")), F.lit(0)).cast("double").alias("repeat_cost"),
    )
    return row.withColumn("fcr", ratio(F.col("first_contact"), F.col("resolved"))).select("resolved", "first_contact", "fcr", "repeat_contacts", "repeat_cost")
