import random

from pyspark.sql import functions as F

from tallyforge.operators import contacts, ranks

DAY = 24 * 3600


def test_newest_of_each_group(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(500)]), i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "g string, t long, id long").repartition(5)
    want = set()
    for g in {r[0] for r in rows}:
        want |= set(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[-40:])
    assert {tuple(r) for r in ranks.newest(frame, ["g"], ["t", "id"], 40).collect()} == want
    plan = ranks.newest(frame, ["g"], ["t", "id"], 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("MapInPandas")  # tasks keep their last ones before anything is shuffled
    monkeypatch.setattr(ranks, "_KEPT", 50)
    assert {tuple(r) for r in ranks.newest(frame, ["g"], ["t", "id"], 40).collect()} == want
    assert ranks.newest(frame.limit(0), ["g"], ["t", "id"], 40).count() == 0


def test_repeat_contacts(spark):
    rng = random.Random(9)
    base = 1_700_000_000
    rows = []
    for i in range(700):
        c = base + rng.randrange(0, 120 * DAY) // 3600 * 3600  # whole hours, so that bounds are met
        r = rng.choice([None, c + rng.choice([-5, 0, 3, 24 * 3, 24 * 40]) * 3600])
        rows.append((i, rng.choice(["hot", "hot", "x", None]), rng.choice(["p", "q", None]), None if rng.random() < 0.05 else c, r))
    frame = spark.createDataFrame(rows, "id long, who string, what string, created long, resolved long").withColumns({c: F.timestamp_seconds(c) for c in ("created", "resolved")})
    got = {r["id"]: (r["contacts_after"], r["resolutions_before"]) for r in contacts.repeat_contacts(frame, ["who", "what"], "created", "resolved").collect()}
    for i, who, what, c, r in rows:
        same = [x for x in rows if x[0] != i and None not in (who, what) and x[1:3] == (who, what)]
        after = None if r is None else sum(x[3] is not None and r < x[3] <= r + 30 * DAY for x in same)
        before = sum(x[4] is not None and c is not None and c - 30 * DAY <= x[4] < c for x in same)
        assert got[i] == (after, before)
    told = contacts.repeat_contacts(frame, ["who", "what"], "created", "resolved")
    row = contacts.first_contact_resolution(told, F.lit(True), F.lit(210.0)).first()
    assert row["resolved"] == sum(v[0] is not None for v in got.values()) and row["repeat_cost"] == 210.0 * sum(v[1] > 0 for v in got.values())
    assert contacts.first_contact_resolution(told.limit(0), F.lit(True), F.lit(1.0)).first()["fcr"] is None


def _contacts(spark, rng, n):
    """Tickets with times to the microsecond about a few moments, and what brute force counts for each."""
    base, span, rows = 1_700_000_000_000_000, 30 * DAY * 1_000_000, []
    for i in range(n):
        c = rng.choice([None, *[base + rng.choice([0, span, 2 * span, 40 * DAY * 1_000_000]) + rng.choice([-1, 0, 1]) for _ in range(9)]])
        r = rng.choice([None, *[base + rng.choice([0, span, 2 * span]) + rng.choice([-1, 0, 1]) for _ in range(4)]])
        rows.append((i, rng.choice(["hot", "hot", "x", None]), rng.choice([1, 1, 2, None]), c, r))
    rows += rng.sample(rows, n // 10)  # some come twice; each is a ticket
    frame = spark.createDataFrame(rows, "item long, who string, `a what` long, created long, resolved long").withColumns({c: F.timestamp_micros(c) for c in ("created", "resolved")})
    want = []
    for k, (i, who, what, c, r) in enumerate(rows):
        same = [x for j, x in enumerate(rows) if j != k and None not in (who, what) and x[1:3] == (who, what)]
        after = None if r is None else sum(x[3] is not None and r < x[3] <= r + span for x in same)
        want.append((i, after, sum(x[4] is not None and c is not None and c - span <= x[4] < c for x in same)))
    return frame.repartition(3), sorted(want, key=str)


def test_repeat_contacts_of_busy_and_quiet_issues(spark, monkeypatch):
    frame, want = _contacts(spark, random.Random(10), 500)
    for most, found in ((1_000, 0), (100, 1), (0, 4)):  # tickets of a quiet issue, busy ones of four
        monkeypatch.setattr(contacts, "_BUSY", most)
        assert contacts.busy_issues(frame.where("who is not null and `a what` is not null"), ["who", "a what"]).count() == found
        got = contacts.repeat_contacts(frame, ["who", "a what"], "created", "resolved")
        assert got.columns == [*frame.columns, "contacts_after", "resolutions_before"]
        assert sorted(((r["item"], r["contacts_after"], r["resolutions_before"]) for r in got.collect()), key=str) == want
    assert contacts.repeat_contacts(frame.limit(0), ["who", "a what"], "created", "resolved").collect() == []


def test_quiet_issues_are_dealt_once(spark):
    frame, _ = _contacts(spark, random.Random(11), 200)
    told = contacts.repeat_contacts(frame, ["who", "a what"], "created", "resolved")
    told.collect()
    plan = told._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan  # the branch of busy issues is empty and gone


def test_a_busy_issue_spreads_over_its_days(spark, monkeypatch):
    monkeypatch.setattr(contacts, "_BUSY", 100)
    rows = [(i, "hot", 1_700_000_000 + i * DAY // 10, 1_700_000_000 + (i * DAY // 10 + 3600 if i % 2 else 0)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, who string, created long, resolved long").withColumns({c: F.timestamp_seconds(c) for c in ("created", "resolved")})
    told = contacts.repeat_contacts(frame, ["who"], "created", "resolved").where("id % 2 = 1")
    assert {r["contacts_after"] for r in told.where("id < 1600").collect()} == {300}
    spread = told.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 600
