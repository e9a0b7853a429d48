import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.llm import mixing, packing


def brute_rates(tokens, p, want, steps=20000):
    """Plain projected gradient on 1 + p mu, to convergence."""
    r = np.ones(len(tokens))
    a = tokens[:, None] * p
    step = 0.5 / np.linalg.norm(a.T @ p, 2)
    for _ in range(steps):
        r = np.maximum(0, r + p @ (want - a.T @ r) * step)
    return r


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 0.7, 0.4], 300)
    tokens = rng.integers(1, 500, 300)
    spread = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens long, p array<double>")
    steps, want = mixing.fit_rates(spread, mixing.TARGETS)
    got = spread.withColumn("r", mixing._rate(steps)).toPandas()
    rate, mass = got["r"].to_numpy(), got["tokens"].to_numpy()[:, None] * np.stack(got["p"])
    reference = brute_rates(got["tokens"].to_numpy().astype(float), np.stack(got["p"]), want)
    reached = rate @ mass
    assert (rate >= 0).all()
    assert np.abs(reached - want).max() <= max(1e-5 * want.sum(), 1.05 * np.abs(reference @ mass - want).max())


def test_classifier_and_edges(spark, odd):
    texts = [(i, ("good clean words here " if i % 3 == 0 else "bad junk stuff now " if i % 3 == 1 else "awful idiot talk ") * 5) for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 1 else 1, int(i % 3 == 2)) for i in range(60)] + [(0, 1, 0), (None, 1, 0), (70, None, 1)], "doc_id long, quality int, toxic int")
    found = mixing.mixing_rates(docs, labels).toPandas()
    rest = found[found["doc_id"] >= 60]
    assert [int(np.argmax(p)) for p in rest["p"]] == [int(i % 3) for i in rest["doc_id"]]
    tokens, p = found["tokens"].to_numpy().astype(float), np.stack(found["p"])
    share = (found["rate"].to_numpy() * tokens) @ p
    assert share / share.sum() == pytest.approx([0.90, 0.09, 0.01], abs=0.01)
    kept = mixing.mix(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(0, 90, 3)}
    assert mixing.mixing_rates(odd, labels).count() == odd.count()
    assert mixing.mix(odd, labels).columns == odd.columns
    assert mixing.mixing_rates(docs.limit(0), labels).count() == 0
    none = mixing.mixing_rates(docs, labels.limit(0)).agg(F.count("*"), F.min("rate")).first()
    assert none[0] == 90 and none[1] >= 0


TEXTS = [(i, ("good clean words here " if i % 3 == 0 else "bad junk stuff now " if i % 3 == 1 else "awful idiot talk ") * (1 + i % 7)) for i in range(90)]


def labelled(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 0 if i % 3 == 1 else 1, int(i % 3 == 2)) for i in range(60)], "doc_id long, quality int, toxic int")


def test_posteriors_equal_the_softmax_of_hashed_words(spark, odd):
    docs, labels = labelled(spark)
    model = mixing.fit_classifier(docs, labels)
    hashing, regression = model.stages
    weights, bias = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    for df in (docs, odd):
        got = [(r["doc_id"], r["tokens"], r["p"]) for r in mixing.posteriors(df, model).collect()]
        for (doc, tokens, p), r in zip(got, df.collect()):
            words = re.findall(r"[^\x00-\x20]+", (r["text"] or "").lower())
            at = sorted({hashing.indexOf(w) for w in set(words)})
            score = weights[:, at].sum(axis=1) + bias
            want = np.exp(score - score.max())
            assert doc == r["doc_id"] and tokens == len(words)
            assert p == pytest.approx(list(want / want.sum()), abs=1e-9)


def test_rates_and_draws_equal_brute_force(spark, odd):
    docs, labels = labelled(spark)
    found = mixing.mixing_rates(docs, labels).toPandas()
    tokens, p = found["tokens"].to_numpy().astype(float), np.stack(found["p"])
    want = np.array([0.90, 0.09, 0.01]) * (tokens @ p)[0] / 0.90
    reference = brute_rates(tokens, p, want)
    assert np.abs((found["rate"].to_numpy() * tokens) @ p - want).max() <= max(1e-3 * want.sum(), 1.05 * np.abs((reference * tokens) @ p - want).max())
    assert found["residual"].nunique() == 1 and found["residual"][0] == pytest.approx(np.linalg.norm((found["rate"] * tokens) @ p - want) / want.sum(), abs=1e-9)
    for df in (docs, odd):
        rates = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(df, labels).collect()}  # rows of one doc_id have one text here
        times = Counter()
        for r in df.withColumn("u", F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)).collect():
            times[str(Row(**{c: r[c] for c in df.columns}))] += math.floor(rates[r["doc_id"]] + r["u"])
        drawn = mixing.mix(df, labels)
        assert drawn.columns == df.columns
        assert Counter(str(r) for r in drawn.collect()) == +times


def test_other_token_counts_and_warning(spark):
    docs, labels = labelled(spark)
    twice = mixing.mixing_rates(docs, labels, tokens=F.length("text")).orderBy("doc_id").toPandas()
    assert twice["tokens"].tolist() == [len(t) for _, t in TEXTS]
    counted = docs.select(packing.token_count(F.col("text")).alias("n")).toPandas()["n"].tolist()
    words = packing.tokenizer(packing.default_vocabulary())
    assert counted == [len(ids) for ids in words.batch([t for _, t in TEXTS])]
    spread = mixing.posteriors(docs, mixing.fit_classifier(docs, labels))
    with pytest.warns(UserWarning, match="not settled"):
        mixing.fit(spread, mixing.TARGETS, max_steps=0)
