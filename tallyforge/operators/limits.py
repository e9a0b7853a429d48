"""Fixed-window rate limits over a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Requests that a class of callers has in a window, and its seconds.
LIMITS = {"public": (30, 60), "authenticated": (120, 60), "internal": (600, 60), "llm": (60, 60)}


def parse(limit: str) -> tuple[int, int]:
    """``requests/seconds``, both whole and above zero."""
    parts = limit.split("/")
    if len(parts) != 2 or not all(p.strip().isdigit() and int(p) > 0 for p in parts):
        raise ValueError(f"a limit is requests/seconds, not {limit!r}")
    return int(parts[0]), int(parts[1])


def by_class(limits: dict[str, tuple[int, int]], name: Column) -> tuple[Column, Column]:
    """Requests and seconds of a caller's class; null for a class without a limit."""
    pick = lambda k: F.coalesce(*[F.when(name == c, F.lit(v[k]).cast("long")) for c, v in limits.items()])
    return pick(0), pick(1)


def admitted(requests: DataFrame, caller: Sequence[str], at: str, order: Sequence[str], limit: Column, seconds: Column) -> DataFrame:
    """``requests`` with ``window_start`` (seconds since 1970), ``nth``, ``allowed`` and ``retry_after_seconds``.

    Windows are fixed and aligned to the clock. Of a caller's requests in a
    window the first ``limit`` are allowed, by time, then by ``order``, which
    should tell rows apart; the others learn how many whole seconds are left of
    the window, one at least. A request without a time or whose class has no
    limit is allowed, and not counted. A caller's work
    is cut by window, so one with very many requests spreads over its windows.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    second = F.floor(micros / 1_000_000)
    start = second - F.pmod(second, seconds)
    nth = F.row_number().over(Window.partitionBy(*caller, "window_start").orderBy(at, *order))
    counted = requests.withColumn("window_start", start).withColumn("_limit", limit).withColumn("_ends", F.col("window_start") + seconds)
    known = F.col("window_start").isNotNull() & F.col("_limit").isNotNull()
    told = counted.withColumn("nth", F.when(known, nth).cast("long"))
    allowed = F.coalesce(F.col("nth") <= F.col("_limit"), F.lit(True))
    left = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_ends") - micros / 1_000_000))
    return told.withColumn("allowed", allowed).withColumn("retry_after_seconds", F.when(~F.col("allowed"), left)).drop("_limit", "_ends")
