"""The nearest vectors of two dealt tables, block by block.

Questions and entries are dealt to blocks by a hash; where a block of questions
meets a block of entries, one product of matrices tells which pairs can be the
best, and their cosines are then added up component by component. A pair is never
a row, only the best of a question in a block is, so what is shuffled and held
does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Questions and entries that meet in one task.
ASKED, HELD = 4096, 2048
#: Questions that are multiplied with a block of entries at a time.
_TILE = 256
_NEAR = 1e-9  # a product of matrices is nearer to the cosine than this


def blocks(rows: Column, size: int) -> Column:
    return F.ceil(rows / size)


def dealt(own: str, n: Column) -> Column:
    """The block that a row is dealt to by its id."""
    return F.pmod(F.xxhash64(own), n)


def each(n: Column) -> Column:
    """One row for every block of the other side."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def usable(vectors: Sequence) -> np.ndarray:
    """Which vectors have a length: not null, empty or zero, and without null or non-finite components."""
    out = np.zeros(len(vectors), dtype=bool)
    for i, x in enumerate(vectors):
        if x is not None and len(x):
            x = np.asarray(x, dtype=np.float64)
            with np.errstate(over="ignore"):
                out[i] = np.isfinite(x).all() and 0 < x @ x < np.inf
    return out


class _Side:
    """Vectors of one width: as they are by component, as unit vectors, and their squared lengths, added up in order."""

    def __init__(self, rows: pd.DataFrame, v: str):
        self.rows = rows
        matrix = np.stack(rows[v].to_numpy()).astype(np.float64)
        self.components = np.ascontiguousarray(matrix.T)
        self.squares = np.zeros(len(rows))
        for x in self.components:
            self.squares += x * x
        self.units = matrix / np.sqrt(self.squares)[:, None]


def _cosines(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs, added up in the order of the components: equal vectors have equal ones wherever they meet."""
    dot = np.zeros(len(i))
    for x, y in zip(a.components, b.components):
        dot += x[i] * y[j]
    with np.errstate(over="ignore", under="ignore"):
        size = a.squares[i] * b.squares[j]
    plain = (size > 1e-290) & (size < np.inf)
    size = np.where(plain, np.sqrt(size), np.sqrt(a.squares[i]) * np.sqrt(b.squares[j]))
    return np.clip(dot / size, -1.0, 1.0)


def _by_width(rows: pd.DataFrame, v: str) -> dict[int, pd.DataFrame]:
    """Rows with a usable vector; vectors of unequal width have no cosine."""
    rows = rows[usable(rows[v].to_numpy())]
    return dict(iter(rows.groupby(rows[v].map(len).to_numpy()))) if len(rows) else {}


def _tiles(asked: pd.DataFrame, held: pd.DataFrame, ringed: bool) -> Iterator[tuple[_Side, np.ndarray, _Side, slice]]:
    """Few questions at a time, with the entries in the rings that they reach."""
    entries = _by_width(held.sort_values("ring", kind="stable") if ringed else held, "cv")
    for width, questions in _by_width(asked.sort_values("low", kind="stable") if ringed else asked, "v").items():
        if width not in entries:
            continue
        a, b = _Side(questions, "v"), _Side(entries[width], "cv")
        for start in range(0, len(questions), _TILE):
            at, reach = np.arange(start, min(start + _TILE, len(questions))), slice(0, len(b.rows))
            if ringed:
                ring, tile = b.rows["ring"].to_numpy(), questions.iloc[at]
                reach = slice(np.searchsorted(ring, tile["low"].min(), "left"), np.searchsorted(ring, tile["high"].max(), "right"))
            if reach.stop > reach.start:
                yield a, at, b, reach


def _best(a: _Side, at: np.ndarray, b: _Side, reach: slice, least: float, skip_own: bool) -> pd.DataFrame:
    about = a.units[at] @ b.units[reach].T
    entry = b.rows["entry_id"].to_numpy()[reach]
    if skip_own:
        about[a.rows["query_id"].to_numpy()[at][:, None] == entry[None, :]] = -2.0
    i, j = np.nonzero(about >= np.maximum(about.max(axis=1), max(least, -1.0))[:, None] - _NEAR)
    cosine = _cosines(a, at[i], b, reach.start + j)
    found = pd.DataFrame({"query_id": a.rows["query_id"].to_numpy()[at[i]], "entry_id": entry[j], "similarity": cosine, "at": i})
    found = found[(cosine >= least) & ((found["query_id"] != found["entry_id"]) | (not skip_own))]
    return found.sort_values(["at", "similarity", "entry_id"], ascending=[True, False, True]).drop_duplicates("at")


def _pairs(a: _Side, at: np.ndarray, b: _Side, reach: slice, least: float, skip_own: bool) -> pd.DataFrame:
    about = (a.units[at] @ b.units[reach].T).ravel()
    found = pd.DataFrame({"query_id": np.repeat(a.rows["query_id"].to_numpy()[at], reach.stop - reach.start), "entry_id": np.tile(b.rows["entry_id"].to_numpy()[reach], len(at)), "similarity": about})
    return found[found["query_id"] != found["entry_id"]] if skip_own else found


def met(asked: DataFrame, held: DataFrame, keys: Sequence[str], least: float, skip_own: bool, ringed: bool = False, every: bool = False) -> DataFrame:
    """(query_id, entry_id, similarity): of each block, the best entry of each question, with a cosine of ``least`` or more.

    ``asked``: ``keys``, query_id, v; ``held``: ``keys``, entry_id, cv; ids are not
    null. Where ``ringed``, questions have ``low`` and ``high`` and meet the
    entries whose ``ring`` is between. ``every`` returns all pairs that are looked
    at, which is meant for counting them.
    """
    looked = _pairs if every else _best
    columns = ["query_id", "entry_id", "similarity"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [looked(*tile, least, skip_own)[columns] for tile in _tiles(left, right, ringed)]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    types = f"query_id {asked.schema['query_id'].dataType.simpleString()}, entry_id {held.schema['entry_id'].dataType.simpleString()}, similarity double"
    own = held.toDF(*held.columns)  # both may come from one table, whose columns have to be told apart
    return asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(meet, types)


def best(found: DataFrame) -> DataFrame:
    """The best of each question's blocks; equal similarities go to the smaller entry_id."""
    return found.groupBy("query_id").agg(F.max_by("entry_id", F.struct("similarity", -F.col("entry_id"))).alias("entry_id"), F.max("similarity").alias("similarity"))
