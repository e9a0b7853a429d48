import pytest
from pyspark.sql import functions as F

from tallyforge.operators import allocation
from tallyforge.sources import loads


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/desk"
    assert loads.read(spark, root) == {} and loads.manifest(spark, root) is None
    make = lambda k: {"a": spark.range(k).withColumn("k", F.lit(k)), "b": spark.range(10 * k).withColumn("k", F.lit(k))}
    seen = lambda: {n: (df.count(), df.agg(F.max("k")).first()[0]) for n, df in loads.read(spark, root).items()}
    first = loads.load(spark, root, make(3))
    assert first["number"] == 1 and {n: t["rows"] for n, t in first["tables"].items()} == {"a": 3, "b": 30}
    assert seen() == {"a": (3, 3), "b": (30, 3)}
    held = loads.read(spark, root)

    dies = make(4)
    dies["b"] = dies["b"].withColumn("k", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        loads.load(spark, root, dies)
    assert seen() == {"a": (3, 3), "b": (30, 3)}  # the first table of the dead load is there and not seen

    loads.load(spark, root, make(5))
    assert seen() == {"a": (5, 5), "b": (50, 5)} and held["b"].count() == 30  # who began to read goes on with what was there
    assert loads.read(spark, root, 1)["a"].count() == 3
    with pytest.raises(FileNotFoundError):
        loads.read(spark, root, 9)
    assert len(loads.forget(spark, root, keep=1)) == 2
    assert seen() == {"a": (5, 5), "b": (50, 5)}
    assert loads.load(spark, root, {"a": spark.range(0)})["number"] == 3 and set(loads.read(spark, root)) == {"a"}


def test_two_loads_at_once_take_two_numbers(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/desk"
    loads.load(spark, root, {"a": spark.range(1)})
    numbers = loads._numbers
    stale = iter([[]])
    monkeypatch.setattr(loads, "_numbers", lambda *a: next(stale, None) if (x := numbers(*a)) is None else next(stale, x))
    assert loads.load(spark, root, {"a": spark.range(2)})["number"] == 2  # number 1, seen as free, was taken


def test_pages_by_seeking(spark):
    rows = [(i % 7 if i % 5 else None, i) for i in range(103)]
    frame = spark.createDataFrame(rows, "v long, id long").repartition(4)
    for down in (True, False):
        key = lambda r: (r[0] is None, (-r[0] if down else r[0]) if r[0] is not None else 0, r[1])  # noqa: E731,B023
        want, got, after = sorted(rows, key=key), [], None
        while True:
            found = allocation.seek(frame, [("v", down), ("id", False)], 20, after)
            assert found.total == 103
            got += [tuple(r) for r in found.rows.collect()]
            after = found.after
            if after is None:
                break
        assert got == want
    none = allocation.seek(frame.limit(0), [("id", False)], 5)
    assert none.total == 0 and none.after is None and none.rows.count() == 0
