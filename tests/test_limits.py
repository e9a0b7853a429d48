import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import limits
from tallyforge.streaming import limiter


def brute(rows, limit, seconds):
    """rows (caller, id, epoch seconds) in their order -> {id: (window, nth, allowed, retry)}"""
    counts, out = {}, {}
    for caller, i, at in rows:
        start = int(at // seconds * seconds)
        nth = counts[caller, start] = counts.get((caller, start), 0) + 1
        out[i] = (start, nth, nth <= limit, None if nth <= limit else max(1, -int(-(start + seconds - at) // 1)))
    return out


def stamp(at):
    return dt.datetime.fromtimestamp(at, dt.timezone.utc)


def told(frame):
    return {r["request_id"]: (r["window_start"], r["nth"], r["allowed"], r["retry_after_seconds"]) for r in frame.collect()}


def test_table(spark):
    rng = random.Random(1)
    rows = sorted(((rng.choice("abc"), i, 1_700_000_000 + rng.randrange(0, 2_000_000) / 1000) for i in range(3000)), key=lambda r: (r[2], r[1]))
    frame = spark.createDataFrame([(c, i, stamp(a)) for c, i, a in rows], "caller string, request_id long, at timestamp")
    got = limits.admitted(frame, ["caller"], "at", ["request_id"], F.lit(7), F.lit(60))
    assert told(got) == brute(rows, 7, 60)


def test_first_requests_pass_then_wait(spark):
    frame = spark.createDataFrame([("x", i, stamp(1_700_000_040 + i)) for i in range(4)], "caller string, request_id long, at timestamp")
    rows = limits.admitted(frame, ["caller"], "at", ["request_id"], F.lit(3), F.lit(60)).orderBy("request_id").collect()
    assert [r["allowed"] for r in rows] == [True] * 3 + [False] and rows[3]["retry_after_seconds"] >= 1


def test_classes_nulls_and_parsing(spark):
    assert limits.parse("3/60") == (3, 60)
    for bad in ("3", "3/0", "a/b", "-1/60"):
        with pytest.raises(ValueError):
            limits.parse(bad)
    frame = spark.createDataFrame([("public", "x", 1, None), ("other", "x", 2, stamp(0)), ("llm", "x", 3, stamp(5))], "kind string, caller string, request_id long, at timestamp")
    n, seconds = limits.by_class({"llm": (1, 10), "public": (1, 10)}, F.col("kind"))
    rows = limits.admitted(frame, ["kind", "caller"], "at", ["request_id"], n, seconds).collect()
    assert all(r["allowed"] for r in rows) and {r["request_id"]: r["nth"] for r in rows} == {1: None, 2: None, 3: 1}
    assert limits.admitted(frame.limit(0), ["caller"], "at", ["request_id"], F.lit(1), F.lit(1)).count() == 0


def test_stream_goes_on_after_a_restart_and_forgets(spark, tmp_path):
    for k, v in limiter.STATE_STORE.items():
        spark.conf.set(k, v)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "caller string, request_id long, at timestamp"

    def arrive(rows):
        spark.createDataFrame([(c, i, stamp(a)) for c, i, a in rows], schema).coalesce(1).write.mode("append").parquet(source)
        requests = spark.readStream.schema(schema).parquet(source)
        query = limiter.admitted(requests, 3, 60).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return query

    base = 1_700_000_040  # a window's start
    rows = [[("a", 1, base + 1.5), ("a", 2, base + 2), ("b", 3, base + 3)], [("a", 4, base + 4), ("a", 5, base + 5.25), ("b", 6, base + 70)], [("a", 7, base + 130), ("b", 8, base + 131)]]
    queries = [arrive(r) for r in rows]  # each is a new query on the same checkpoint
    assert told(spark.read.parquet(sink)) == brute(sum(rows, []), 3, 60)
    left = queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left < 8  # counts and timers of windows that have passed are gone
