"""A stored index of vectors that answers the nearest-entry question exactly.

Angles between vectors are a metric. An entry lies in the cell of its nearest
pivot, in a ring of like angles to it, so a question knows from its own angles to
the pivots which rings can hold an entry within a given angle: others need no
look. It first looks near its home, which gives an angle that the nearest entry
keeps to at least, and then into the rings that this angle reaches. Batches of
entries are appended to the index under the pivots it began with; any pivots give
exact answers, good ones only save comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import cosines

CELLS = 64
#: Width of a ring, in radians.
RING = 0.05
_SAFE = 1e-7  # for rounding: never skip what a bound just reaches


@dataclass
class Index:
    """``pivots``: unit vectors, one in a row; ``entries``: entry_id, scope, v, cell, ring."""

    pivots: np.ndarray
    entries: DataFrame


def _angles(pivots: np.ndarray, vectors: Sequence) -> np.ndarray:
    """Each usable vector's angles to the pivots; without any, all entries are in one ring."""
    if not len(pivots) or not len(vectors):
        return np.zeros((len(vectors), max(len(pivots), 1)))
    matrix = np.stack(list(vectors)).astype(np.float64)
    return np.arccos(np.clip(matrix / np.linalg.norm(matrix, axis=1)[:, None] @ pivots.T, -1.0, 1.0))


def _places(v: Column, pivots: np.ndarray) -> Column:
    """Cell and ring of a vector; a cell of -1 if it is null, empty, zero or holds a null or non-finite component."""

    def place(vectors: pd.Series) -> pd.DataFrame:
        able, cell, ring = cosines.usable(vectors), np.full(len(vectors), -1, np.int32), np.zeros(len(vectors), np.int32)
        if able.any():
            angles = _angles(pivots, vectors[able])
            cell[able] = angles.argmin(axis=1)
            ring[able] = np.floor(angles.min(axis=1) / RING)
        return pd.DataFrame({"cell": cell, "ring": ring})

    return F.pandas_udf(place, "cell int, ring int").asNondeterministic()(v)  # or it would run once for the filter and again


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.pandas_udf(lambda v: pd.Series(cosines.usable(v)), "boolean")("v"))


def write_index(entries: DataFrame, path: str, cells: int = CELLS) -> Index:
    """The index of ``entries`` (entry_id, scope, v) under ``path``. Its pivots are ``cells`` of them, drawn by a hash."""
    unit = F.pandas_udf(lambda v: pd.Series([np.asarray(x, np.float64) / np.linalg.norm(np.asarray(x, np.float64)) for x in v], dtype=object), "array<double>")
    drawn = _usable(entries).orderBy(F.xxhash64("entry_id")).limit(cells)
    drawn.select(unit("v").alias("u")).write.mode("overwrite").parquet(f"{path}/pivots")
    (entries.limit(0).select("entry_id", "scope", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("cell"), F.lit(0).alias("ring"))).write.mode("overwrite").parquet(f"{path}/entries")
    return append(entries, path)


def append(entries: DataFrame, path: str) -> Index:
    """``entries`` added to the index under ``path``; those that are there stay as they are."""
    pivots = read_index(entries.sparkSession, path).pivots
    placed = entries.select("entry_id", "scope", F.col("v").cast("array<double>").alias("v"), _places(F.col("v"), pivots).alias("at")).where("at.cell >= 0")
    placed.select("entry_id", "scope", "v", "at.cell", "at.ring").sortWithinPartitions("scope", "cell", "ring").write.mode("append").parquet(f"{path}/entries")
    return read_index(entries.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/pivots").collect()  # ``cells`` vectors
    return Index(np.array([r["u"] for r in rows], dtype=np.float64), spark.read.parquet(f"{path}/entries"))


def _reach(asked: DataFrame, index: Index, home: bool) -> DataFrame:
    """``asked`` with the rings of each cell, ``low`` to ``high``, where entries within its ``angle`` may lie; with ``home``, the ring that it would be in itself and the next ones."""
    pivots = index.pivots

    def reach(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for vectors, angle in batches:
            angles = _angles(pivots, vectors)
            if home:
                own = np.arange(angles.shape[1]) == angles.argmin(axis=1)[:, None]
                ring = np.floor(angles / RING).astype(np.int32)
                low, high = np.where(own, ring - 1, 0), np.where(own, ring + 1, -1)
            else:
                most = angle.to_numpy()[:, None]
                low = np.floor(np.maximum(angles - most - _SAFE, 0) / RING).astype(np.int32)
                high = np.floor((angles + most + _SAFE) / RING).astype(np.int32)
            yield pd.DataFrame({"low": list(low), "high": list(high)})

    return asked.withColumn("_at", F.pandas_udf(reach, "low array<int>, high array<int>")("v", "angle"))


def compared(asked: DataFrame, index: Index, home: bool, skip_own: bool, least: float = -1.0, every: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """(query_id, entry_id, similarity) of the pairs that are looked at, or without ``every`` of the best of each block (``cosines``).

    A question goes once to each cell that it reaches, not to each ring; a large
    cell is dealt to blocks, and a block's entries are looked at by rings.
    ``counted``: the same questions, where they are cheaper to count.
    """
    entries = index.entries.where("scope is not null")
    asked_rows = (asked if counted is None else counted).groupBy("scope").agg(cosines.blocks(F.count("*"), cosines.ASKED).alias("_rows"))
    cells = entries.groupBy("scope", "cell").agg(F.min("ring").alias("first"), F.max("ring").alias("last"), cosines.blocks(F.count("*"), cosines.HELD).alias("_cols"))
    sizes = cells.join(asked_rows, "scope")
    listed = sizes.groupBy("scope").agg(F.first("_rows").alias("_rows"), F.collect_list(F.struct("cell", "first", "last", "_cols")).alias("cells"))  # as many as pivots
    low, high = lambda c: F.get("_at.low", c["cell"]), lambda c: F.get("_at.high", c["cell"])
    met = F.filter("cells", lambda c: (low(c) <= high(c)) & (low(c) <= c["last"]) & (high(c) >= c["first"]))
    reached = _reach(asked, index, home).join(listed, "scope").withColumn("c", F.explode(met)).withColumn("_row", cosines.dealt("query_id", F.col("_rows")))
    left = reached.select("scope", "c.cell", "_row", cosines.each(F.col("c._cols")).alias("_col"), "query_id", "v", low(F.col("c")).alias("low"), high(F.col("c")).alias("high"))
    held = entries.join(sizes.select("scope", "cell", "_cols", "_rows"), ["scope", "cell"])
    right = held.select("scope", "cell", cosines.each(F.col("_rows")).alias("_row"), cosines.dealt("entry_id", F.col("_cols")).alias("_col"), "entry_id", F.col("v").alias("cv"), "ring")
    return cosines.met(left, right, ["scope", "cell", "_row", "_col"], least, skip_own, ringed=True, every=every)


def bounded(asked: DataFrame, index: Index, least: float, skip_own: bool = False) -> DataFrame:
    """``asked`` with the angle that its nearest entry keeps to, from a look at home; never wider than ``least`` allows."""
    told = _usable(asked).select("query_id", "scope", F.col("v").cast("array<double>").alias("v")).withColumn("angle", F.lit(float(np.arccos(least))))
    found = compared(told, index, True, skip_own, every=False, counted=asked).groupBy("query_id").agg(F.max("similarity").alias("s"))
    return told.join(found, "query_id", "left").withColumn("angle", F.least("angle", F.coalesce(F.acos("s"), F.col("angle")))).drop("s")


def nearest(asked: DataFrame, index: Index, least: float = 0.93, skip_own: bool = False) -> DataFrame:
    """(query_id, entry_id, similarity): the nearest entry of the same scope with a cosine of ``least`` or more, as ``retrieval.cached_answer`` finds it.

    ``asked``: query_id, scope, v; query_id tells questions apart. Equal
    similarities go to the smaller entry_id. Questions and entries without a
    usable vector, and null scopes, have no answer.
    """
    return cosines.best(compared(bounded(asked, index, least, skip_own), index, False, skip_own, least, every=False, counted=asked))
