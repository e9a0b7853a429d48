"""Connected components of an edge table, by repeated contraction.

A round points every node at its smallest neighbour, flattens the pointers by
doubling, and replaces the edges by edges between the roots. Every round at
least halves the nodes, so the rounds grow with the logarithm of a component's
diameter. All steps are equi-joins that adaptive execution can split and
aggregates that combine before the shuffle, so a hub holding a third of the
edges does not land in one task. Nothing but row counts, observed while a table
is written, reaches the driver; a table of few rows is written by few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch

#: Rows a task writes where there are few.
_ROWS = 50_000


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Self-loops, repeated edges and null ends are ignored. An empty edge table
    gives an empty result.
    """

    def save(df: DataFrame, name: str, most: int | None, seen: str = "true") -> tuple[DataFrame, int]:
        """The table, written by no more tasks than ``most`` rows need, and how many of its rows are ``seen``."""
        told = Observation()
        df = df if most is None else df.coalesce(max(1, -(-most // _ROWS)))
        return scratch.save(df.observe(told, F.count_if(F.expr(seen)).alias("n")), name), told.get["n"]

    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    edges, n = save(ordered.distinct(), "edges-0", None)
    roots, n_roots, turn = None, 0, 0
    while n:
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
        parent, nodes = save(nearest, f"parent-{turn}-0", 2 * n)
        jump, moved = 0, 1
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            doubled = parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            doubled, moved = save(doubled, f"parent-{turn}-{jump + 1}", nodes, "moved")
            scratch.drop(f"parent-{turn}-{jump}")
            parent, jump = doubled.select("node", "root"), jump + 1
        if roots is None:
            merged, n_roots = parent, nodes
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            merged = roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        roots, _ = save(merged, f"roots-{turn}", n_roots)
        if turn:
            scratch.drop(f"roots-{turn - 1}")
        side_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        side_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = (
            edges.join(side_a, "a")
            .join(side_b, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        turn += 1
        edges, n = save(contracted, f"edges-{turn}", n)
        scratch.drop(f"edges-{turn - 1}")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.select("node", F.col("root").alias("component"))
