import random

from pyspark.sql import functions as F

from tallyforge.operators import postings, retrieval


def corpus_of(spark, n=3000):
    """Every item has the frequent words, few have the rare ones."""
    rng = random.Random(6)
    rare = [f"rare{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = ["often"] * rng.randrange(1, 12) + ["usual"] * rng.randrange(0, 9) + rng.choices(rare, k=rng.randrange(0, 3)) + ["filler"] * rng.randrange(1, 30)
        rows.append((i, " ".join(words)))
    rows += [(n, "often often"), (n + 1, "often often"), (n + 2, None), (n + 3, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def same(a, b):
    rows = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(a) == rows(b)


def test_search_equals_the_whole_join_and_opens_less(spark, tmp_path):
    corpus = corpus_of(spark)
    index = postings.write_index(corpus, str(tmp_path / "index"), block=32)
    asked = spark.createDataFrame([(1, "often"), (2, "often usual"), (3, "often rare3"), (4, "usual rare5 rare7 often filler"), (5, "unknown words"), (6, None), (7, "rare1 rare1")], "query_id long, text string")
    for top in (1, 5, 40):
        same(postings.search(asked, index, top), retrieval.bm25(asked, corpus, top))
    opened = postings.opened_blocks(asked, index, 5).groupBy("query_id").agg(F.sum(F.size("entries")).alias("n"))
    whole = retrieval.term_weights(corpus).join(asked.select("query_id", F.explode(F.array_distinct(retrieval.terms(F.col("text")))).alias("term")), "term").groupBy("query_id").agg(F.count("*").alias("n"))
    opened, whole = ({r["query_id"]: r["n"] for r in df.collect()} for df in (opened, whole))
    assert opened[1] < 0.2 * whole[1] and opened[2] < whole[2] and sum(opened.values()) < 0.8 * sum(whole.values())
    assert index.blocks.select(F.max(F.size("entries"))).first()[0] <= 80


def test_priors_and_a_stored_index(spark, tmp_path):
    corpus = corpus_of(spark, 400)
    postings.write_index(corpus, str(tmp_path / "index"), block=16)
    index = postings.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "often"), (2, "rare2 usual"), (3, "unknown")], "query_id long, text string")
    prior = spark.createDataFrame([(1, 7, 1.6), (1, 8, 0.01), (2, 399, 5.0), (3, 1, 0.4)], "query_id long, item_id long, weight double")
    for top in (2, 10):
        same(postings.search(asked, index, top, prior), retrieval.bm25(asked, corpus, top, prior))
    empty = postings.write_index(corpus.limit(0), str(tmp_path / "empty"))
    assert postings.search(asked, empty, 3).count() == 0
