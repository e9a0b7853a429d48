import math
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing, packing
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets import brute_masked
from tests.llm.test_shingles import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def seen(spark, tables, tmp_path_factory):
    """Input and output of each stage over the smallest tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_language_stage(seen):
    before, after = (df.toPandas() for df in seen["language"])
    lettered = {r.doc_id for r in before.itertuples() if any(c.isalpha() for c in r.text)}
    assert list(after.columns) == COLUMNS
    assert set(after["doc_id"]) <= lettered and len(after) >= 0.99 * len(lettered)


def test_near_duplicate_stage(seen):
    """Groups by five-word shingles at 0.8, all pairs compared."""
    before, after = (df.toPandas() for df in seen["near_duplicates"])
    groups = brute_groups(list(zip(before["doc_id"], before["text"])))
    assert list(after.columns) == COLUMNS
    assert sorted(after["doc_id"]) == sorted(set(groups.values())) and len(after) < len(before)
    texts = dict(zip(before["doc_id"], before["text"]))
    assert all(texts[r.doc_id] == r.text for r in after.itertuples())


def test_secret_stage(seen):
    before, after = (df.toPandas() for df in seen["secrets"])
    assert list(after.columns) == COLUMNS
    assert {r.doc_id: (r.text, r.n_chars) for r in after.itertuples()} == {r.doc_id: (brute_masked(r.text), len(brute_masked(r.text))) for r in before.itertuples()}


def test_mixing_stage(spark, tables, seen):
    """Every row is drawn as often as its rate says, and no clean one goes."""
    before, after = seen["mixing"]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rates = {r["doc_id"]: r for r in mixing.mixing_rates(before, labels, tokens=packing.token_count(F.col("text"))).collect()}
    rows = before.withColumn("u", F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)).collect()
    want = Counter({r["doc_id"]: math.floor(rates[r["doc_id"]]["rate"] + r["u"]) for r in rows})
    assert Counter(r["doc_id"] for r in after.select("doc_id").collect()) == +want
    worst = max(r["residual"] for r in rates.values())
    assert worst < 1e-3
    clean = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert all(want[i] >= 1 for i in clean & set(rates) if rates[i]["p"][0] > 0.9)
    assert after.columns == COLUMNS


def test_packing_stage(seen):
    before, after = seen["packing"]
    check_packing(before.dropDuplicates())
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] == 2048 or r["n"] & (r["n"] - 1) == 0 for r in sizes)
    assert after.agg(F.sum("length")).first()[0] == before.agg(F.sum(packing.token_count(F.col("text")))).first()[0]


def test_run(spark, tables, seen):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(out.select("doc_id").collect()) and out.agg(F.sum("length")).first() == seen["packing"][1].agg(F.sum("length")).first()
    assert out.select(key).count() > 0


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_and_empty_documents(spark, tables, odd, tmp_path, rows):
    docs = odd if rows == "odd" else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert (docs.count() > 0) == (rows == "odd")
