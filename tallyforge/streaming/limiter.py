"""Fixed-window rate limits over a stream of requests, with keyed state that expires."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "caller string, request_id long, at timestamp, window_start long, nth long, allowed boolean, retry_after_seconds long"


class FixedWindows(StatefulProcessor):
    """Counts a caller's requests in each of its open windows; a window's count goes when the watermark passes its end."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        start, count = T.StructType([T.StructField("start", T.LongType())]), T.StructType([T.StructField("count", T.LongType())])
        self.counts = handle.getMapState("counts", start, count)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for request, at in batch.sort_values(["at", "request_id"], kind="stable")[["request_id", "at"]].itertuples(index=False):
                moment = at.timestamp()
                start = math.floor(moment) // self.seconds * self.seconds
                seen = (self.counts.getValue((start,)) or (0,))[0] if self.counts.containsKey((start,)) else 0
                if not seen:
                    self.handle.registerTimer((start + self.seconds) * 1000)
                self.counts.updateValue((start,), (seen + 1,))
                allowed = seen < self.limit
                out.append((key[0], request, at, start, seen + 1, allowed, None if allowed else max(1, math.ceil(start + self.seconds - moment))))
            frame = pd.DataFrame(out, columns=["caller", "request_id", "at", "window_start", "nth", "allowed", "retry_after_seconds"])
            yield frame.astype({"retry_after_seconds": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds
        if self.counts.containsKey((start,)):
            self.counts.removeKey((start,))
        return iter(())

    def close(self) -> None:
        return None


def admitted(requests: DataFrame, limit: int, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """A decision for each request (caller, request_id, at) of a stream, as ``operators.limits.admitted`` has it for a table.

    Requests are counted in the order in which batches bring them, within a batch
    by time. One that is later than ``lateness`` behind the newest is dropped, as
    its window may be forgotten. Counts live in the state store, so a restarted
    query goes on counting where it stopped.
    """
    known = requests.where("caller is not null and at is not null").withWatermark("at", lateness)
    return known.groupBy("caller").transformWithStateInPandas(FixedWindows(limit, seconds), SCHEMA, "append", "EventTime")


#: What the state store must be for keyed state with timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
