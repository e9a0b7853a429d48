"""A stored BM25 index whose search skips what cannot be among the best.

Postings of a term are cut by impact: levels of like weight, best first, and
blocks within a level. A block has the items and weights of its postings and
their largest weight. No block needs a whole term in one task, however many
items have it: levels come from the weights themselves, and a level is dealt to
blocks by a hash of the item.

A search first adds up the leading blocks of its terms, which gives a score that
the best items reach at least. A block whose largest weight, with all that the
query's other terms could add, stays below that score holds no item that could be
among them, and is never opened. Items that could are in no such block, under none
of their terms, so their scores are whole and the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.retrieval import term_weights, terms

BLOCK = 128
#: Levels for each doubling of the weight.
_LEVELS = 16
#: Weights are kept in whole billionths, so sums do not depend on their order.
_UNIT = 1_000_000_000


@dataclass
class Index:
    """``blocks``: term, level, best, ahead, entries (item_id, w); ``terms``: term, most, items."""

    blocks: DataFrame
    terms: DataFrame


def write_index(corpus: DataFrame, path: str, block: int = BLOCK) -> Index:
    """The index of ``corpus`` (item_id, text), written to ``path``; blocks are sorted by term and impact, so a reader's filter on terms skips files."""
    w = F.col("w").cast("decimal(18,9)")
    postings = term_weights(corpus).select("term", "item_id", (w * _UNIT).cast("long").alias("w")).withColumn("level", F.floor(F.log2(F.greatest(F.col("w"), F.lit(1))) * _LEVELS))
    sizes = postings.groupBy("term", "level").agg(F.count("*").alias("n"))  # some hundreds of levels a term at most
    better = Window.partitionBy("term").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = sizes.select("term", "level", F.ceil(F.col("n") / block).alias("n_blocks"), F.coalesce(F.sum("n").over(better), F.lit(0)).alias("better"))
    dealt = postings.join(levels, ["term", "level"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("n_blocks")))
    entry = F.struct("item_id", "w")
    blocks = dealt.groupBy("term", "level", "block", "better").agg(F.max("w").alias("best"), F.collect_list(entry).alias("entries"))  # of about ``block``
    told = blocks.select("term", "level", "best", (F.col("better") + F.col("block") * block).alias("ahead"), "entries")
    told.repartitionByRange("term", F.col("level").desc()).sortWithinPartitions("term", F.col("level").desc()).write.mode("overwrite").parquet(f"{path}/blocks")
    index = read_index(corpus.sparkSession, path, terms_too=False)
    each = index.blocks.groupBy("term").agg(F.max("best").alias("most"), F.sum(F.size("entries")).alias("items"))
    each.write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(corpus.sparkSession, path)


def read_index(spark: SparkSession, path: str, terms_too: bool = True) -> Index:
    blocks = spark.read.parquet(f"{path}/blocks")
    return Index(blocks, spark.read.parquet(f"{path}/terms") if terms_too else blocks)


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def opened_blocks(queries: DataFrame, index: Index, top: int, prior: DataFrame | None = None) -> DataFrame:
    """(query_id, term, entries) of the blocks that a search for the ``top`` items has to open."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(index.terms, "term")
    others = asked.groupBy("query_id").agg(F.sum("most").alias("all"))
    if prior is not None:
        others = others.join(prior.groupBy("query_id").agg(F.max(_units("weight")).alias("given")), "query_id", "left").select("query_id", (F.col("all") + F.greatest(F.coalesce("given", F.lit(0)), F.lit(0))).alias("all"))
    bounds = asked.join(others, "query_id").select("query_id", "term", (F.col("all") - F.col("most")).alias("rest"))
    leading = bounds.join(index.blocks.where(F.col("ahead") < top), "term")
    reached = _ranked(_added(leading, prior), top).where(F.col("rank") == top).select("query_id", F.col("score").alias("least"))
    met = bounds.join(index.blocks, "term").join(reached, "query_id", "left")
    return met.where(F.col("least").isNull() | (F.col("best") + F.col("rest") >= F.col("least"))).select("query_id", "term", "entries")


def _units(c: str) -> F.Column:
    return (F.col(c).cast("decimal(18,9)") * _UNIT).cast("long")


def _added(blocks: DataFrame, prior: DataFrame | None) -> DataFrame:
    rows = blocks.select("query_id", F.explode("entries").alias("e")).select("query_id", "e.item_id", "e.w")
    if prior is not None:
        rows = rows.unionByName(prior.select("query_id", "item_id", _units("weight").alias("w")))
    return rows.groupBy("query_id", "item_id").agg(F.sum("w").alias("score"))


def search(queries: DataFrame, index: Index, top: int, prior: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank), as ``retrieval.bm25`` has them, from the blocks that matter.

    ``prior``: query_id, item_id, weight, added to the score. Equal scores go to
    the smaller item_id. A query without known terms and priors has no rows.
    """
    found = _added(opened_blocks(queries, index, top, prior), prior).where("score > 0")
    return _ranked(found, top).select("query_id", "item_id", (F.col("score") / _UNIT).alias("score"), "rank")
