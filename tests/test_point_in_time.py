import datetime as dt
import random

from tallyforge.operators import temporal


def test_point_in_time_without_arrays_or_pairs(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400)) for _ in range(6)]])
    roster = [(rng.choice(["a", "b", "c", None]), day(), day(), f"p{i}") for i in range(60)]
    left = [(i, rng.choice(["a", "b", "d", None]), day()) for i in range(120)]
    got = temporal.point_in_time(spark.createDataFrame(left, "i long, k string, at timestamp"), spark.createDataFrame(roster, "k string, s timestamp, e timestamp, v string"), "k", "at", "s", "e", "v")
    rank = lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[2] is not None, r[2] or dt.datetime.min, r[3])
    want = set()
    for i, k, at in left:
        mine = sorted((r for r in roster if k is not None and r[0] == k), key=rank)
        within = [r for r in mine if (r[1] is None or (at is not None and r[1] <= at)) and (r[2] is None or (at is not None and at <= r[2]))]
        want.add((i, (within or mine)[-1][3] if mine else None, bool(within)))
    assert {(r["i"], r["v"], r["covered"]) for r in got.collect()} == want and got.count() == len(left)
    assert "collect_list" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()


def test_a_hot_key_spreads_over_its_slabs(spark, monkeypatch):
    """One key has all rows; assignments nest, and a few cover very many slabs."""
    rng = random.Random(4)
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    roster = []
    for i in range(1500):
        begin = rng.randrange(3000)
        roster.append(("hot", hour(begin), hour(begin + rng.choice([0, 1, 5, 30, 400, 2500])), i))
    roster += [("hot", None, hour(20), -1), ("hot", hour(2900), None, -2), ("hot", hour(50), hour(10), -3)]
    left = [(i, "hot", hour(rng.randrange(-20, 3200))) for i in range(2500)]
    seen = []
    sweep = temporal._last_open
    monkeypatch.setattr(temporal, "_last_open", lambda events, by: seen.append((by, events)) or sweep(events, by))
    got = temporal.point_in_time(spark.createDataFrame(left, "i long, k string, at timestamp_ntz"), spark.createDataFrame(roster, "k string, s timestamp_ntz, e timestamp_ntz, v long"), "k", "at", "s", "e", "v")
    rank = lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[2] is not None, r[2] or dt.datetime.min, r[3])
    mine = sorted(roster, key=rank)
    want = set()
    for i, _, at in left:
        within = [r for r in mine if (r[1] is None or r[1] <= at) and (r[2] is None or at <= r[2])]
        want.add((i, (within or mine)[-1][3], bool(within)))
    assert {(r["i"], r["v"], r["covered"]) for r in got.collect()} == want
    (_, coarse), (_, fine) = seen
    assert fine.groupBy("_key", "_slab").count().agg({"count": "max"}).first()[0] < 120  # of some 5,700
    assert coarse.count() + fine.count() <= 3 * len(roster) + 2 * len(left)
