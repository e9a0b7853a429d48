import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tallyforge import catalog
from tallyforge.operators import cosines, retrieval


def test_cached_answers_of_a_large_scope_are_dealt_to_blocks(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(900)]
    frame = spark.createDataFrame([(i, "x", v) for i, v in enumerate(vectors)], "id long, scope string, v array<double>")
    asked, cache = frame.where("id < 300").withColumnRenamed("id", "query_id"), frame.where("id >= 300").withColumnRenamed("id", "entry_id")
    found = retrieval.cached_answer(asked, cache, 0.9)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    best = {q: max((cos(vectors[q], vectors[e]), -e) for e in range(300, 900)) for q in range(300)}
    assert {(r["query_id"], r["entry_id"]) for r in found.collect()} == {(q, -e) for q, (s, e) in best.items() if s >= 0.9}
    assert "_row" in found._jdf.queryExecution().analyzed().toString()
    assert found.where(F.col("similarity") < 0.9).count() == 0


def test_pairs_are_no_rows_and_ties_fall_as_in_sql(spark, monkeypatch):
    """Scaled and equal vectors over many blocks, vectors of other widths and without length; cosines to the last bit."""
    monkeypatch.setattr(cosines, "ASKED", 40)
    monkeypatch.setattr(cosines, "HELD", 64)
    rng = random.Random(8)
    base = [[rng.randrange(-40, 40) / 8 for _ in range(6)] for _ in range(60)]
    vectors = [[x * k for x in base[rng.randrange(60)]] for k in (1, 3, 5, 7) for _ in range(100)]
    whole = pd.DataFrame({"id": [2**60 + i for i in range(400)], "scope": [i % 2 for i in range(400)], "v": vectors})
    odd = [(1, 0, None), (2, 0, []), (3, 0, [0.0] * 6), (4, 0, [float("nan")] * 6), (5, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6, 0, [1.0, 2.0]), (7, None, vectors[0])]
    frame = spark.createDataFrame(list(whole.itertuples(index=False, name=None)) + odd, "id long, scope int, v array<float>")
    found = retrieval.cached_answer(frame.withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "entry_id"), 0.3, skip_own=True)
    sql = """WITH s AS (SELECT q.id AS query_id, e.id AS entry_id, list_cosine_similarity(q.v, e.v) AS similarity FROM whole q JOIN whole e USING (scope) WHERE q.id <> e.id)
    SELECT query_id, entry_id, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) = 1"""
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.sql(sql).fetchall())
    assert not any("Join" in line and "_row" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_cosines_whose_lengths_leave_the_doubles(spark):
    frame = spark.createDataFrame([(1, "x", [1e-120, 0.0]), (2, "x", [1e-100, 1e-100]), (3, "x", [1e120, 1e119])], "id long, scope string, v array<double>")
    found = retrieval.cached_answer(frame.withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "entry_id"), 0.3, skip_own=True)
    assert {(r["query_id"], r["entry_id"], round(r["similarity"], 6)) for r in found.collect()} == {(1, 3, 0.995037), (2, 3, 0.773957), (3, 1, 0.995037)}


def test_every_row_of_the_table_asks(spark, tables):
    """Questions were the ids divisible by 20 only."""
    asked = duckdb.sql(f"SELECT DISTINCT q.vec_id FROM '{tables}/embeddings.parquet' q JOIN '{tables}/embeddings.parquet' e USING (label) WHERE q.vec_id <> e.vec_id AND list_cosine_similarity(q.embedding, e.embedding) >= 0.31").fetchall()
    found = {r["query_id"] for r in catalog.QUERIES["q_cached_answer"](spark, tables).collect()}
    assert {x for (x,) in asked} <= found and any(x % 20 for x in found)
