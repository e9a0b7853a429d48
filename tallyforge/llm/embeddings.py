"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are one class from the start, so copies cost nothing. A vector
lives in the cell of its nearest centroid and visits other cells whose centroids
are nearly as near, so that partners meet across cell borders. A partner differs
by a vector no longer than the chord of the linking angle; a cell is visited
where such a difference, turned at random, could change the nearest centroid at
``reach`` standard deviations. ``reach=None`` visits whatever any difference
could change, which loses no link but in high dimensions visits nearly all cells.

Cells grow in number with the vectors. Beyond ``FAN`` of them each is cut by a
second codebook, fitted on what the first leaves over and shared by all cells,
so that what is sent to tasks stays bounded while a cell keeps its size.

The vectors at home in a cell form blocks of bounded size. A task holds one
block, and whoever else lives in or visits the cell streams past it: the block's
vectors count their links with all of them, a visitor counts those that do not
visit its own home, where they meet again. So a pair that meets at all is
counted once at either end. What is passed on are counts and edges that span
what is linked, not the linked pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import Scratch, table

THRESHOLD = 0.95
SAMPLE = 20_000
CELL = 500
#: Centroids of a codebook; cells are as many as two of them give.
FAN = 1024
BLOCK = 4096
REACH = 2.5


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids (k, d) of unit vectors; an empty cell takes the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), size=min(k, len(unit)), replace=False)].copy()
    for _ in range(rounds):
        cosine = unit @ centroids.T
        cell = cosine.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, unit)
        norms = np.linalg.norm(sums, axis=1)
        for empty in np.flatnonzero(norms < 1e-12):
            far = int(cosine.max(axis=1).argmin())
            sums[empty], norms[empty] = unit[far], 1.0
            cosine[far] = 1.0
        centroids = sums / norms[:, None]
    return centroids


def _spanning(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row id, col id) that connect what the linked pairs of two blocks connect: a forest, found by spreading minima."""
    n, m = linked.shape
    label_r, label_c = np.arange(n), np.full(m, n + m)
    parents: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parents.get(x, x)) != x:
            parents[x] = parents.get(up, up)
            x = up
        return x

    out_r, out_c = [], []
    for i in label_r[linked.any(axis=1)]:
        partners = np.flatnonzero(linked[i])
        fresh = partners[label_c[partners] == n + m]
        label_c[fresh] = i
        out_r.append(np.full(len(fresh), i))
        out_c.append(fresh)
        own = find(int(i))
        for other in np.unique(label_c[partners]):
            root = find(int(other))
            if root != own:
                parents[root] = own
                seen = partners[label_c[partners] == other][:1]
                out_r.append(np.full(1, i))
                out_c.append(seen)
    if not out_r:
        return rows[:0], cols[:0]
    return rows[np.concatenate(out_r)], cols[np.concatenate(out_c)]


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK, reach: float | None = REACH, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """(id, n_links, component): other rows with cosine >= ``threshold``, and the smallest id reachable over such links.

    The centroids come from a sample of at most about ``sample`` distinct
    vectors, for cells of about ``cell`` vectors; every vector is compared. A
    pair that does not meet (see the module's text) is missed at both ends. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, and neither do vectors of
    different length. Repeated rows are rows: equal vectors link with each other.
    A null id keeps its row and counts as a partner. Extra columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = scratch.save(rows.select("id", "v", usable.alias("usable")).withColumn("key", F.when(F.col("usable"), F.sha2(F.array_join(F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ","), 256))), "rows")
    classes = scratch.save(rows.where("usable").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "classes")
    n = classes.count()
    links = None
    if n:
        drawn = classes.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
        links = _links(scratch, classes.select("key", "copies", "v"), _codebooks(drawn, n, cell, fan), threshold, block, reach)
        names = classes.select("key", "rep")
        ends = links.where("other is not null").select("key", "other").distinct()
        ids = ends.join(names, "key").withColumnRenamed("rep", "a").join(names.select(F.col("key").alias("other"), F.col("rep").alias("b")), "other").select("a", "b")
        found = connected_components(scratch, ids)
        counts = links.groupBy("key").agg(F.sum("n").alias("n"))
        classed = classes.select("key", "rep", "copies").join(counts, "key", "left").join(found, F.col("rep") == F.col("node"), "left")
        classed = scratch.save(classed.select("key", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
        return rows.join(classed, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))


def _codebooks(drawn: DataFrame, n: int, cell: int, fan: int) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """By dimension the centroids and, where more cells are needed, what is added to each of them; fitted on the driver from the bounded sample."""
    by_size: dict[int, list] = {}
    for v in drawn.select("v").toPandas()["v"]:
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, found in by_size.items():
        unit = _unit(pd.Series(found))
        cells = max(1, n // cell)
        middle = spherical_kmeans(unit, min(fan, cells))
        added = None
        if cells > fan:
            rest = unit - middle[(unit @ middle.T).argmax(axis=1)]
            length = np.linalg.norm(rest, axis=1, keepdims=True)
            added = spherical_kmeans(rest / np.maximum(length, 1e-9), min(fan, -(-cells // fan))) * np.median(length)
        out[size] = (middle, added)
    return out


def _near(v: np.ndarray, middle: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and which ones a partner no farther than ``step`` may have as its nearest."""
    cosine = v @ middle.T
    home = cosine.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * middle @ middle.T))
    return home, cosine.max(axis=1)[:, None] - cosine <= step * apart[home] + 1e-9


def _cells(v: np.ndarray, books: tuple[np.ndarray, np.ndarray | None] | None, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each vector; and row and cell of every visit, the one at home included."""
    if books is None:  # a dimension that the sample missed is one cell
        return np.zeros(len(v), np.int64), np.arange(len(v)), np.zeros(len(v), np.int64)
    middle, added = books
    home, near = _near(v, middle, step)
    row, first = np.nonzero(near)
    if added is None:
        return home.astype(np.int64), row, first.astype(np.int64)
    homes, rows, cells = np.empty(len(v), np.int64), [], []
    for c in np.unique(first):
        own = row[first == c]
        inner = middle[c] + added
        inner /= np.maximum(np.linalg.norm(inner, axis=1, keepdims=True), 1e-9)
        second, close = _near(v[own], inner, step)
        at_home = home[own] == c
        homes[own[at_home]] = c * len(added) + second[at_home]
        r, k = np.nonzero(close)
        rows.append(own[r])
        cells.append(c * len(added) + k)
    return homes, np.concatenate(rows), np.concatenate(cells)


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(scratch: Scratch, classes: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray | None]], threshold: float, block: int, reach: float | None) -> DataFrame:
    """(key, other, n): per vector and task the copies it links with (other null), and spanning edges (n 0)."""
    chord = np.sqrt(max(0.0, 2 - 2 * threshold))
    kind = classes.schema["v"].dataType.simpleString()
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def assign(batches):
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                home, row, cell = _cells(_unit(part["v"]), books.get(size), chord * (1.0 if reach is None else min(1.0, reach / np.sqrt(size))))
                at_home = home[row] == cell
                order = np.argsort(row, kind="stable")
                visits = np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                visits = [visits[r] if h else None for r, h in zip(row, at_home)]
                yield pd.DataFrame({"key": part["key"].to_numpy()[row], "copies": part["copies"].to_numpy()[row], "v": part["v"].to_numpy()[row], "size": size, "cell": cell, "home": home[row], "visits": visits})

    placed = scratch.save(classes.mapInPandas(assign, f"key string, copies long, v {kind}, size int, cell long, home long, visits array<long>"), "placed")
    at_home = F.col("home") == F.col("cell")
    blocks = placed.where(at_home).groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = placed.join(blocks, ["size", "cell"])  # a cell where nobody lives has nothing to count
    row = ["size", "cell", "block", "first", "key", "copies", "v", "home", "visits"]
    held = dealt.where(at_home).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("first", F.lit(0)).select(row)
    passing = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.lit(1)).withColumn("visits", F.lit(None).cast("array<long>")).select(row)
    group = ["size", "cell", "block"]
    streams = held.union(passing).repartition(parts, *group).sortWithinPartitions(*group, "first")

    def multiply(batches):
        current, homes, held = None, [], None
        for batch in batches:
            for name, part in batch.groupby(group, sort=False):
                if name != current:
                    current, homes, held = name, [], None
                own = part[part["first"] == 0]
                if len(own):
                    homes.append(own)
                others = part[part["first"] == 1]
                for at in range(0, len(others), block):
                    if not homes:  # no vector was dealt to this block
                        break
                    if held is None:
                        held = pd.concat(homes, ignore_index=True)
                        unit, names, copies = _unit(held["v"]), held["key"].to_numpy(), held["copies"].to_numpy()
                        visited, visitor = np.concatenate(held["visits"].tolist()), np.repeat(np.arange(len(held)), held["visits"].map(len))
                    yield count_links(name[1], unit, names, copies, visited, visitor, others.iloc[at : at + block])

    def count_links(cell, unit, names, copies, visited, visitor, others):
        linked = unit @ _unit(others["v"]).T >= threshold
        passing, home = others["key"].to_numpy(), others["home"].to_numpy()
        linked &= names[:, None] != passing[None, :]
        n, some = linked @ others["copies"].to_numpy(), np.zeros(len(others), np.int64)
        for h in np.unique(home[linked.any(axis=0)]):
            if h != cell:  # a visitor meets those who visit its home there
                stays = np.ones(len(names), bool)
                stays[visitor[visited == h]] = False
                some[home == h] = (copies * stays) @ linked[:, home == h]
        ends_a, ends_b = _spanning(linked, names, passing)
        return pd.concat([
            pd.DataFrame({"key": names[n > 0], "other": None, "n": n[n > 0]}), pd.DataFrame({"key": passing[some > 0], "other": None, "n": some[some > 0]}), pd.DataFrame({"key": ends_a, "other": ends_b, "n": 0}),
        ], ignore_index=True)

    return scratch.save(streams.mapInPandas(multiply, "key string, other string, n long"), "links")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cosine_components(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
part AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT p.a AS vec_id, coalesce(n.n_links, 0) AS n_links, p.component_id, p.a = p.component_id AS kept
FROM part p LEFT JOIN n ON n.a = p.a
"""

QUERIES = {"op6_embeddings": op6_embeddings}
ORACLES = {"op6_embeddings": SQL}
