import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyforge.llm import exact


def brute(rows, normalise=lambda t: t, largest=False):
    """rows (id, text) in their order -> sorted (id, keep_id, size, kept, sha)"""
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(normalise(text or ""), []).append((doc, i))
    out = []
    for text, members in groups.items():
        known = [m for m in members if m[0] is not None]
        if known:
            best = (max if largest else min)(m[0] for m in known)
            stays = min(i for d, i in known if d == best)
        else:
            best, stays = None, min(i for _, i in members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, best, len(members), i == stays, digest) for d, i in members]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r[c] for c in ("id", "keep_id", "group_size", "kept", "text_sha256")) for r in frame.collect()), key=repr)


def test_against_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for largest in (False, True):
        assert got(exact.exact_groups(odd, largest=largest)) == brute(rows, largest=largest)


def test_copies_over_many_ranges(spark, tmp_path):
    """One text holds a third of all rows, one a third of them without an id, one shares its first bytes with many others."""
    rng = random.Random(5)
    rows = [(rng.randrange(10_000), "the same text for all of these") for _ in range(2000)] + [(None, None)] * 2000
    rows += [(rng.randrange(10_000), "a long beginning that very many texts have in common: " + str(rng.randrange(300))) for _ in range(1500)]
    rows += [(i, f"{i} alone") for i in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    frame.write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = spark.read.parquet(f"{tmp_path}/docs")
        found = exact.exact_groups(docs, largest=True)
        assert found.count() == len(rows)
        told = {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in found.collect()}
        want = {(sha, keep, size) for _, keep, size, _, sha in brute(rows, largest=True)}
        assert told == want
        assert found.where("kept").count() == len(want)
        assert found.where("kept and not (id <=> keep_id)").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_text_lies_in_several_ranges(spark):
    rows = spark.createDataFrame([(i, "x" * 50) for i in range(4000)], "doc_id long, text string")
    named = rows.withColumn("salt", F.xxhash64("doc_id"))
    splitters = exact._splitters(named, 8)
    assert len(splitters) == 7 and len({s[: 2 * exact.FRONT] for s in splitters}) == 1


def test_normalised_texts(spark):
    rows = [(3, "A  b\tC "), (2, "a b c"), (1, "a bc"), (None, " a b\nc"), (5, "É b"), (4, "é b")]
    fold = lambda t: re.sub("[ \t-\r]+", " ", "".join(c.lower() if c.isascii() else c for c in t)).strip(" ")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact.exact_groups(frame, normalise=exact.folded)) == brute(rows, fold)


def test_rows_that_stay(spark, odd):
    wide = odd.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(2))).withColumn("range", F.lit("x")).withColumn("carried", F.lit("x"))
    out = exact.drop_copies(wide)
    assert out.columns == wide.columns and dict(out.dtypes)["m"] == dict(wide.dtypes)["m"]
    # three rows of the fox, null and empty texts are one, so 11 rows are 8 groups
    assert out.count() == 8 and out.where("doc_id = 1").count() == 1 and out.where("doc_id in (2, 4)").count() == 0
    assert exact.drop_copies(odd.limit(0)).count() == 0 and exact.exact_groups(odd.limit(0)).count() == 0


def test_no_python_and_one_exchange(documents, monkeypatch):
    plans = []
    save = exact.Scratch.save
    monkeypatch.setattr(exact.Scratch, "save", lambda self, df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or save(self, df, name))
    final = exact.exact_groups(documents)._jdf.queryExecution().toString()
    for plan in [final, *[p for _, p in plans]]:
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    sort = dict(plans)["ordered"]
    assert len(re.findall(r"\bExchange\b", sort)) == 1 and len(re.findall(r"\bSort\b", sort)) == 1
