"""Keyword retrieval with BM25, and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.patterns import CLASSIFICATION_SECTIONS, INTENT_SECTIONS, MONEY_INTENTS, REFUND_RULES, STOP_WORDS
from tallyforge.operators import cosines

K1, B = 1.4, 0.75


def terms(text: Column) -> Column:
    """Lower-case letters and digits, three or more together, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def term_weights(corpus: DataFrame) -> DataFrame:
    """(term, item_id, w): what a query that has the term gains from the item; ``corpus``: item_id, text."""
    words = corpus.select("item_id", terms(F.col("text")).alias("t"))
    size = words.select("item_id", F.size("t").alias("len"))
    stats = size.agg(F.count("*").alias("n_items"), F.avg("len").alias("mean_len"))
    tf = words.select("item_id", F.explode("t").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    return tf.join(df, "term").join(size, "item_id").crossJoin(stats).select("term", "item_id", weight.alias("w"))  # stats: one row


def bm25(queries: DataFrame, corpus: DataFrame, top: int, prior: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the best ``top`` items of each query with a score above 0.

    ``queries``: query_id, text; ``corpus``: item_id, text; ``prior``: query_id,
    item_id, weight, added to the score. A query's repeated terms count once. The
    corpus's statistics are aggregates; queries meet items through shared terms,
    in an equality join that only carries ids and weights. Scores are sums of
    decimals, so equal texts have equal scores; ties go to the smaller item_id.
    Every item that shares a term is met: ``postings`` has an index that skips
    most of them.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    scores = asked.join(term_weights(corpus), "term").groupBy("query_id", "item_id").agg(F.sum(F.col("w").cast("decimal(18,9)")).cast("double").alias("score"))
    if prior is not None:
        scores = scores.join(prior, ["query_id", "item_id"], "full").select("query_id", "item_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def section_priors(queries: DataFrame) -> DataFrame:
    """(query_id, item_id, weight) of the sections that belong to the intent of each of ``queries`` (query_id, intent): 1.6 for the first, 0.4 less for each further."""
    listed = F.coalesce(*[F.when(F.col("intent") == k, F.array(*map(F.lit, v))) for k, v in INTENT_SECTIONS.items()], F.array(*map(F.lit, INTENT_SECTIONS["other"])))
    return queries.select("query_id", F.posexplode(listed).alias("at", "item_id")).select("query_id", "item_id", (1.6 - 0.4 * F.col("at")).alias("weight"))


def policy_sections(queries: DataFrame, corpus: DataFrame, top: int = 3) -> DataFrame:
    """The sections of ``corpus`` (item_id, text) for ``queries`` (query_id, text, intent): BM25 with the intent's priors, and the refund rules always where money is asked for."""
    known = section_priors(queries).join(corpus.select("item_id"), "item_id", "left_semi")
    found = bm25(queries.select("query_id", "text"), corpus, top, known)
    rules = corpus.where(F.col("item_id") == REFUND_RULES).select("item_id").limit(1).withColumnRenamed("item_id", "_rules")
    money = queries.crossJoin(rules).select("query_id", F.col("intent").isin(*MONEY_INTENTS).alias("money"))  # by one row at most
    return force_include(found, money, F.lit(REFUND_RULES), F.col("money"), top)


def classification_sections(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, item_id, score, matched): the sections that the classifying of a refund is always given, as far as ``corpus`` has them.

    ``queries``: query_id, text. Each section scores 1; matched are the terms that
    text and section share, sorted. The sections are few and go to every task.
    """
    given = corpus.where(F.col("item_id").isin(*CLASSIFICATION_SECTIONS)).select("item_id", F.array_distinct(terms(F.col("text"))).alias("_terms"))
    said = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("_said"))
    both = said.crossJoin(F.broadcast(given))  # three rows
    return both.select("query_id", "item_id", F.lit(1.0).alias("score"), F.array_sort(F.array_intersect("_said", "_terms")).alias("matched"))


def force_include(found: DataFrame, queries: DataFrame, item: Column, needed: Column, top: int) -> DataFrame:
    """``found`` with ``item`` first, at score 0, for the queries that need it and lack it; their last item goes."""
    lacking = queries.where(needed).select("query_id").join(found.where(F.col("item_id") == item).select("query_id"), "query_id", "left_anti")
    shifted = found.join(lacking.withColumn("_add", F.lit(1)), "query_id", "left").withColumn("rank", F.col("rank") + F.coalesce("_add", F.lit(0))).where(F.col("rank") <= top).drop("_add")
    return shifted.unionByName(lacking.select("query_id", item.alias("item_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")))


def cached_answer(asked: DataFrame, cache: DataFrame, least: float = 0.93, skip_own: bool = False) -> DataFrame:
    """The nearest cached entry of each question of the same scope with a cosine of at least ``least``.

    ``asked``: query_id, scope, v; ``cache``: entry_id, scope, v; ids are not null.
    A scope is one policy version and intent and holds the entries that are still
    alive. The questions and entries of a scope are dealt to blocks of bounded
    size, every block of questions meets every block of entries in a product of
    matrices (``cosines``), and the best of each meeting are reduced to one per
    question, so a large scope spreads over many tasks and no pair is a row.
    Vectors that are null, zero or hold null or non-finite components have and are
    no answer. ``skip_own``: an entry of the question's own id is no answer to it.
    """
    counted = lambda df, name, size: df.groupBy("scope").agg(cosines.blocks(F.count("*"), size).alias(name))
    sizes = counted(asked, "_rows", cosines.ASKED).join(counted(cache, "_cols", cosines.HELD), "scope")
    dealt = lambda df, own, mine, other: df.join(sizes, "scope").withColumn(mine, cosines.dealt(own, F.col(f"{mine}s"))).withColumn(other, cosines.each(F.col(f"{other}s"))).drop("_rows", "_cols")
    left = dealt(asked.select("scope", "query_id", "v"), "query_id", "_row", "_col")
    right = dealt(cache.select("scope", "entry_id", F.col("v").alias("cv")), "entry_id", "_col", "_row")
    return cosines.best(cosines.met(left, right, ["scope", "_row", "_col"], least, skip_own))
