import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import embeddings


def brute(rows, threshold=0.95):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) else None for _, v in rows]
    linked = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    label = [r[0] for r in rows]
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
    return sorted((rows[i][0], len(linked[i]), label[i]) for i in range(n))


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = sorted(tuple(r) for r in embeddings.cosine_components(df, **options).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [0.3, 1.0]), (12, [0.3, 1.0])]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.cosine_components(empty).count() == 0


@pytest.mark.parametrize("reach", [embeddings.REACH, None])
def test_crowds_and_cell_borders(spark, reach):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for size in (1, 1, 1, 5, 40, 300):
        centre = rng.normal(size=16)
        for _ in range(size):
            rows.append((k, (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist()))
            k += 1
    check(spark, rows, block=64, reach=reach)


def test_recall(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = {i: n for i, n, _ in brute(rows)}
    got = {r["id"]: r["n_links"] for r in embeddings.cosine_components(df).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


@pytest.mark.parametrize("reach", [embeddings.REACH, None])
def test_two_codebooks_and_many_blocks(spark, reach):
    """More cells than one codebook has, crowds of more than a block; without a reach every link is found, with it most, and at both ends."""
    rng = np.random.default_rng(9)
    rows = []
    for size in [1] * 60 + [2] * 60 + [4] * 40 + [30, 120]:
        centre = rng.normal(size=16)
        for _ in range(size):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.15).astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.cosine_components(df, block=32, cell=10, fan=6, reach=reach).collect()}
    want = {i: (n, c) for i, n, c in brute(rows)}
    if reach is None:
        assert got == want
    else:
        assert all(got[i][0] <= want[i][0] for i in want) and sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
        unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
        alone = [(i, j) for i in want for j in want if i < j and unit[i] @ unit[j] >= 0.95 and want[i][0] == want[j][0] == 1]
        assert alone and all(got[i][0] == got[j][0] for i, j in alone)
