"""Joins in time, durations and service levels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_or_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """``left`` with the right ``value`` last at or before its time, else the latest of the key, and ``link`` saying which.

    ``link``: as_of, unique (the key has one right row, whenever it is), latest,
    or unresolved (none). Rows without a time take the latest. Equal times go to
    the largest value. The work is cut by key and day: a row looks at its own
    day, and at the last right row of the days before, so a key with many rows
    spreads over its days and no pairs of rows are formed. Null right times serve
    as the earliest of all.
    """
    row = Window.partitionBy("_key", "_day").orderBy("_ts", F.col("_side"), "_value").rowsBetween(Window.unboundedPreceding, 0)
    day = lambda c: F.to_date(F.col(c))
    stamp = F.struct(F.col(right_ts).alias("ts"), F.col(value).alias("value"))
    named = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), day(right_ts).alias("_day"), F.col(value).alias("_value"), stamp.alias("_stamp"))
    per_day = named.where("_ts is not null").groupBy("_key", "_day").agg(F.max("_stamp").alias("_last"))
    asked = left.select(F.col(key).alias("_key"), day(left_ts).alias("_day")).where("_key is not null and _day is not null").distinct()
    before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        asked.join(per_day, ["_key", "_day"], "full")
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .select("_key", "_day", "_carry")
    )
    totals = named.groupBy("_key").agg(F.count("*").alias("_n"), F.max("_stamp").alias("_latest"))
    columns = [c for c in left.columns if c != value]
    none = F.lit(None).cast(right.schema[value].dataType)
    l = left.select(*columns, F.col(key).alias("_key"), F.col(left_ts).alias("_ts"), day(left_ts).alias("_day"), none.alias("_value"), F.lit(1).alias("_side"))
    r = named.where("_ts is not null").select("_key", "_ts", "_day", "_value", F.lit(0).alias("_side"))
    own = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_ts").alias("ts"), F.col("_value").alias("value"))), ignorenulls=True).over(row)
    seen = l.unionByName(r, allowMissingColumns=True).withColumn("_own", own).where("_side = 1")
    out = seen.join(carry, ["_key", "_day"], "left").join(totals, "_key", "left")
    held = F.coalesce(F.when(F.col("_ts").isNotNull(), F.coalesce("_own", "_carry")))
    n = F.coalesce("_n", F.lit(0))
    link = F.when(n == 0, "unresolved").when(n == 1, "unique").when(held.isNotNull(), "as_of").otherwise("latest")
    picked = F.when(n > 0, F.when((n > 1) & held.isNotNull(), held["value"]).otherwise(F.col("_latest.value")))
    return out.select(*columns, picked.alias(value), link.alias("link"))


#: Microseconds of the time spans that ``point_in_time`` cuts a key's work into.
SLAB = 24 * 3600 * 1_000_000
_FOREVER = float("inf")


def _last_open(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _t, _held): for the asked times among ``events`` the entry that starts last of those that are open then; none, no row.

    ``events``: by, _t, _ask, _until, _entry; an entry is open from _t (null:
    always) to _until (null: for ever), both included. Each partition's rows come
    sorted by group and time and pass once. What is carried along is a stack of
    open entries, later starts above: whoever ends no later than one above can
    never be the answer again and goes when that one comes, and whoever has
    closed goes when it is found on top. So a group of any length needs memory
    for its nested entries only.
    """
    n = len(by)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, carried = None, [], None  # stack: (until, place of the entry in ``pool``)
        for batch in batches:
            entries = batch.column("_entry")
            carried = entries.slice(0, 0) if carried is None else carried
            pool, rows, found = pa.concat_arrays([carried, entries]), [], []
            groups = zip(*[batch.column(k).to_pylist() for k in range(n)])
            times = (batch.column(c).to_pylist() for c in ("_t", "_ask", "_until"))
            for i, (key, t, ask, until) in enumerate(zip(groups, *times)):
                if key != group:
                    group, stack = key, []
                if ask:
                    while stack and stack[-1][0] < t:
                        stack.pop()
                    if stack:
                        rows.append(i)
                        found.append(stack[-1][1])
                else:
                    until = _FOREVER if until is None else until
                    while stack and stack[-1][0] <= until:
                        stack.pop()
                    stack.append((until, len(carried) + i))
            told = batch.select([*by, "_t"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*told.columns, pool.take(pa.array(found, pa.int64()))], [*by, "_t", "_held"])
            carried = pool.take(pa.array([at for _, at in stack], pa.int64()))
            stack = [(until, at) for at, (until, _) in enumerate(stack)]

    ordered = events.select(*by, "_t", "_ask", "_until", "_entry").repartition(*by).sortWithinPartitions(*by, F.col("_t").asc_nulls_first(), "_ask", "_entry")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name in (*by, "_t")]
    return ordered.mapInArrow(walk, ", ".join([*kinds, f"_held {ordered.schema['_entry'].dataType.simpleString()}"]))


def point_in_time(left: DataFrame, roster: DataFrame, key: str, at: str, start: str, end: str, value: str, slab: int = SLAB) -> DataFrame:
    """``left`` with the ``value`` of the roster row of its key that covers its time.

    Open bounds are null; a bound is compared as a time, so a date covers until
    its midnight. Of several covering rows the one that starts last counts, of
    these the one with the later end, then the larger value; where none covers,
    the row that is last in that order.

    Time is cut into slabs, and a key's work with it, so that a key with many
    rows spreads. An assignment comes to the slab it starts in and to the slab it
    ends in. The slabs between are swept first, a slab for a moment, over one
    assignment for each first and last slab of a key; a slab that is asked for
    gets the one that covers it whole. Then starts and asked times of each slab
    are swept in order. So an assignment makes three rows at most, however long
    it is, and neither arrays of a key nor pairs of rows are formed.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slab_of = lambda c: F.expr(f"({c} - pmod({c}, {slab}L)) div {slab}L")
    columns = left.columns
    entry = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).alias("v"))
    named = roster.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), micros(start).alias("_s"), micros(end).alias("_e"), entry.alias("_entry"))
    named = named.withColumns({"_a": slab_of("_s"), "_b": slab_of("_e")})
    totals = named.groupBy("_key").agg(F.max("_entry").alias("_latest"), F.max(F.when(F.col("_entry.s").isNull() & F.col("_entry.e").isNull(), F.col("_entry"))).alias("_always"))
    times = left.select(F.col(key).alias("_key"), micros(at).alias("_t")).where("_key is not null and _t is not null").distinct().withColumn("_slab", slab_of("_t"))
    asks = lambda df: df.withColumns({"_ask": F.lit(True), "_until": F.lit(None).cast("long"), "_entry": F.lit(None).cast(named.schema["_entry"].dataType)})

    long_ones = named.where("_b is null or _a is null or _b > _a + 1").groupBy("_key", "_a", "_b").agg(F.max("_entry").alias("_entry"))
    whole = long_ones.select("_key", (F.col("_a") + 1).alias("_t"), F.lit(False).alias("_ask"), (F.col("_b") - 1).alias("_until"), "_entry")
    asked_slabs = asks(times.select("_key", F.col("_slab").alias("_t")).distinct())
    covers = _last_open(whole.unionByName(asked_slabs), ["_key"])

    event = lambda df, of, t, until, held: df.select("_key", F.col(of).alias("_slab"), t.alias("_t"), F.lit(False).alias("_ask"), until.alias("_until"), F.col(held).alias("_entry"))
    own = (F.col("_s"), F.col("_e"), "_entry")
    starts = event(named.where("_a is not null"), "_a", *own)
    ends = event(named.where("_b is not null and (_a is null or _b > _a)"), "_b", *own)
    between = event(covers, "_t", micros("_held.s"), micros("_held.e"), "_held")
    held = _last_open(starts.unionByName(ends).unionByName(between).unionByName(asks(times)), ["_key", "_slab"]).select("_key", F.col("_t").alias("_at"), "_held")

    row = left.withColumns({"_key": F.col(key), "_at": micros(at)})
    out = row.join(held, ["_key", "_at"], "left").join(totals, "_key", "left")
    inside = F.when(F.col("_at").isNull(), F.col("_always")).otherwise(F.col("_held"))
    picked = F.when(inside.isNotNull(), inside["v"]).otherwise(F.col("_latest")["v"])
    return out.select(*[c for c in columns if c != value], picked.alias(value), inside.isNotNull().alias("covered")).select(*columns, *([] if value in columns else [value]), "covered")


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000.0


def sla(target_by: dict[str, float], channel: Column, minutes: Column) -> tuple[Column, Column]:
    """Target minutes and whether they were exceeded; unknown where either is."""
    target = F.coalesce(*[F.when(channel == k, F.lit(float(v))) for k, v in target_by.items()])
    return target, minutes > target


def month_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def quarter_key(ts: Column) -> Column:
    return F.coalesce(F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)), F.lit("unknown"))


def days_since(ordered: Column, at: Column) -> Column:
    return F.datediff(at, ordered)
