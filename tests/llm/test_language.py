import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import language


def test_held_out_accuracy(documents):
    found = language.identify(documents).select("doc_id", "lang", "found.*", language.held_out().alias("held")).toDF("doc_id", "lang", "pred", "score", "held").toPandas()
    assert (found["held"] == found["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = found[found["held"]]
    assert (held["lang"] == held["pred"]).mean() >= 0.95
    assert found["score"].between(0, 1).all()


def test_edges(odd):
    rows = {r["doc_id"]: (r["found"], r["found"]["lang"]) for r in language.identify(odd).collect()}
    assert all(rows[i][1] == "und" and rows[i][0]["score"] == 0 for i in (3, 4, 5, 7))
    assert rows[1][1] != "und" and rows[None][1] != "und"
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 1, 2, 6, 8, 9]
    assert language.identify(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.identify(unlabelled).where("found.lang <> 'und'").count() == 0


def test_bundle_by_hand():
    vectors = {c: language._letter_vector(ord(c) if c != " " else 0, 64).astype(int) for c in "ab "}
    roll = np.roll
    want = sum(roll(vectors[x], 2) * roll(vectors[y], 1) * vectors[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    (got,) = language._bundles(["Ab! A"], 64)
    assert got.tolist() == want.tolist()


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "aa bb" if zlib.crc32(str(i).encode()) % 5 else "zz yy", "x" if zlib.crc32(str(i).encode()) % 5 else "y") for i in range(60)], "doc_id long, text string, lang string")
    assert list(language.train_prototypes(docs)) == ["x"]


def test_unlearned_scripts_go_and_one_clean_word_stays(spark, documents):
    learnt = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    rng = np.random.default_rng(4)
    scripts = [(0x10A0, 38), (0x0531, 38), (0x05D0, 27), (0x0E01, 46), (0xAC00, 2000)]  # Georgian, Armenian, Hebrew, Thai, Hangul
    word = lambda at, n: "".join(chr(at + int(k)) for k in rng.integers(0, n, 7))
    alien = [(-1 - i, " ".join(word(*scripts[i % 5]) for _ in range(1 + i)), None) for i in range(100)]
    words = learnt.selectExpr("lang", "explode(split(lower(text), '[^a-z]+')) as w").where("length(w) >= 4").groupBy("lang", "w").count().where("count >= 20").orderBy("w").limit(100)
    single = [(-1000 - i, r["w"], None) for i, r in enumerate(words.collect())]
    rows = spark.createDataFrame(alien + single, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.keep_identified(learnt.union(rows)).where("doc_id < 0").collect()}
    assert all(i <= -1000 for i in kept) and len(kept) >= 0.98 * len(single)


def slow_bundle(text, dim):
    """The bundle of a text, trigram by trigram; runs of other characters are one boundary, as are both ends."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return None
    line = f" {' '.join(letters.split())} "
    vector = lambda c: language._letter_vector(0 if c == " " else ord(c), dim).astype(float)
    return sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(line, line[1:], line[2:]))


def test_predictions_equal_the_slow_way(spark, documents, odd):
    dim = 128
    docs = documents.select("doc_id", F.substring("text", 1, 300).alias("text"), "lang").orderBy("doc_id").limit(80).union(odd.where("doc_id <> 6 or doc_id is null").select("doc_id", "text", "lang"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    sums = {}
    for r in docs.collect():
        bundle = slow_bundle(r["text"], dim)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and bundle is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + bundle / np.linalg.norm(bundle)
    prototypes = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    for r in language.identify(docs, dim).collect():
        bundle = slow_bundle(r["text"], dim)
        if bundle is None:
            assert tuple(r["found"]) == ("und", 0.0)
            continue
        cosine = {k: float(v @ bundle / np.linalg.norm(bundle)) for k, v in prototypes.items()}
        assert abs(r["found"]["score"] - min(1, max(0, max(cosine.values())))) < 1e-5
        assert cosine[r["found"]["lang"]] > max(cosine.values()) - 1e-5
