import collections
import random

from pyspark.sql import functions as F

from tallyforge.operators import evaluation


def test_top_confusions_work_out_each_label_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["a", "b", "c", "d", None])) for _ in range(300)]
    texts = spark.createDataFrame(rows, "e string, p string").repartition(3)
    labelled = texts.select(F.upper("e").alias("expected"), F.upper(F.reverse("p")).alias("predicted"))
    counts = evaluation.confusion(labelled, "expected", "predicted")
    wrong = collections.Counter((e.upper(), p and p.upper()) for e, p in rows if e and e != p)
    want = sorted(((e, p, n) for (e, p), n in wrong.items()), key=lambda r: (-r[2], r[0], r[1] or ""))
    for limit in (5, len(want), 100):
        assert [tuple(r) for r in evaluation.top_confusions(counts, limit).collect()] == want[:limit]
    top = evaluation.top_confusions(counts)._jdf.queryExecution().optimizedPlan().toString()
    assert top.count("reverse(") == 1
    assert evaluation.top_confusions(evaluation.confusion(labelled.limit(0), "expected", "predicted")).collect() == []
    hits = counts.where("expected = predicted")
    assert evaluation.top_confusions(hits).collect() == []
