import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, grams=1, buckets=10_000, least=20, percent=10, seed=2024):
    """docs: (id, text) in their order"""

    def bag(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    bags = [(i, *bag(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in bags for b in f), Counter(b for x in target for b in bag(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * float(S + buckets) / ((s[b] + 1.0) * float(T + buckets)))) for b in s}
    out = []
    for place, (i, n_words, found) in enumerate(bags):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words, place])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(frame):
    return sorted((tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=repr)


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_against_brute_force(spark, documents, tables):
    target = spark.read.parquet(f"{tables}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    assert got(resampling.resample(documents, target)) == brute(rows_of(documents), texts)
    more = {"grams": 3, "buckets": 257, "percent": 35, "seed": 1}
    assert got(resampling.resample(documents, target, least_words=5, **more)) == brute(rows_of(documents), texts, least=5, **more)


def test_odd_tables(spark, odd):
    odd = odd.withColumn("a.b", F.lit(1)).withColumn("buckets", F.lit("x")).withColumn("place", F.lit("x")).withColumn("weight", F.lit("x"))
    target = spark.createDataFrame([(1, "The quick fox"), (2, None), (3, "")], "item_id long, text string").withColumn("id", F.lit(1))
    for wanted in (target, target.limit(0)):
        texts = [r["text"] for r in wanted.collect()]
        want = brute(rows_of(odd), texts, least=0, percent=50)
        assert got(resampling.resample(odd, wanted, least_words=0, percent=50)) == want
    assert resampling.resample(odd.limit(0), target).count() == 0


def test_draws_favour_the_target(spark):
    docs = spark.createDataFrame([(i, ("alpha beta " if i % 2 else "gamma delta ") * 15) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("alpha beta beta",)], "text string")
    out = resampling.resample(docs, target, percent=50)
    drawn = [r["id"] for r in out.where("rank is not null").collect()]
    assert len(drawn) == 200 and sum(i % 2 for i in drawn) == 200
    assert sorted(r["rank"] for r in out.where("rank is not null").collect()) == list(range(1, 201))


def test_ranks_over_many_partitions(spark):
    frame = spark.range(0, 5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resampling.ranked(resampling.Scratch(spark, "ranks"), frame, [F.col("v").desc(), F.col("id")], "ordered").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["rank"] for r in sorted(out, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 5001))


def test_no_python(documents, spark, tables, monkeypatch):
    plans = []
    save = resampling.Scratch.save
    monkeypatch.setattr(resampling.Scratch, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, name))
    plans.append(resampling.resample(documents, spark.read.parquet(f"{tables}/benchmark.parquet"))._jdf.queryExecution().toString())
    assert not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
