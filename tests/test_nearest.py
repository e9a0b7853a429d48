
import numpy as np

from tallyforge.operators import cosines, nearest, retrieval


def test_exact_with_few_comparisons(spark, tmp_path):
    """Clusters of near vectors in two scopes; the second half of the entries is appended."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vectors = [(centres[i % 40] + 0.08 * rng.normal(size=16)).tolist() for i in range(2400)]
    rows = [(i, "xy"[i % 2], v) for i, v in enumerate(vectors)]
    rows += [(5000, "x", None), (5001, "x", [0.0] * 16), (5002, "x", [float("nan")] * 16), (5003, "x", vectors[0]), (5004, None, vectors[0])]
    frame = spark.createDataFrame(rows, "id long, scope string, v array<double>")
    entries, path = frame.withColumnRenamed("id", "entry_id"), f"file://{tmp_path}/index"
    nearest.write_index(entries.where("entry_id % 4 < 2"), path, cells=24)
    index = nearest.append(entries.where("entry_id % 4 >= 2"), path)
    asked = frame.where("id % 15 = 0 or id >= 5000").withColumnRenamed("id", "query_id")

    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    scope = {i: s for i, s, _ in rows}
    ids = np.array([i for i in unit if scope[i] is not None])
    matrix = np.stack([unit[i] for i in ids])
    for least in (0.9, 0.3):
        want = {}
        for q in (i for i in unit if (i % 15 == 0 or i >= 5000) and scope[i] is not None):
            cos = matrix @ unit[q]
            able = [(round(float(c), 12), -int(i)) for c, i in zip(cos, ids) if i != q and scope[i] == scope[q] and c >= least]
            if able:
                want[q] = max(able)
        got = {r["query_id"]: (round(r["similarity"], 12), -r["entry_id"]) for r in nearest.nearest(asked, index, least, skip_own=True).collect()}
        assert got == want
    looked = nearest.compared(nearest.bounded(asked, index, 0.3, True), index, False, True).count()
    assert looked < 0.25 * asked.count() * len(ids) / 2  # of all pairs of a scope


def test_nothing_to_find(spark, tmp_path):
    empty = spark.createDataFrame([], "entry_id long, scope string, v array<double>")
    index = nearest.write_index(empty, f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.0])], "query_id long, scope string, v array<double>")
    assert nearest.nearest(asked, index).count() == 0
    assert nearest.nearest(asked.limit(0), nearest.append(asked.withColumnRenamed("query_id", "entry_id"), f"file://{tmp_path}/none")).count() == 0


def test_vectors_without_clusters_as_all_pairs(spark, tmp_path, monkeypatch):
    """Bounds do not help: blocks meet, no pair is a row, and cosines are those of ``cached_answer`` to the last bit."""
    monkeypatch.setattr(cosines, "ASKED", 30)
    monkeypatch.setattr(cosines, "HELD", 20)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(500, 7)).astype(np.float32)
    vectors[400:] = 3 * vectors[:100]
    frame = spark.createDataFrame([(2**60 + i, i % 2, v.tolist()) for i, v in enumerate(vectors)], "id long, scope int, v array<float>")
    asked, entries, path = frame.where("id % 4 = 0").withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "entry_id"), f"file://{tmp_path}/index"
    nearest.write_index(entries.where("entry_id % 3 <> 0"), path, cells=8)
    found = nearest.nearest(asked, nearest.append(entries.where("entry_id % 3 = 0"), path), 0.2, skip_own=True)
    got = sorted(map(tuple, found.collect()))
    assert len(got) == 125 and got == sorted(map(tuple, retrieval.cached_answer(asked, entries, 0.2, skip_own=True).collect()))
    assert not any("Join" in line and ("_row" in line or "ring#" in line) for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
