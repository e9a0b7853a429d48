"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits, cut into two 32-bit
segments, agree up to one bit in one of them. Each fingerprint is therefore
indexed under its 2 x 32 one-wildcard segment variants; fingerprints that meet
in a variant are joined by equality and verified by Hamming distance.

Only distinct fingerprints take part, so copies cost nothing. A variant shared
by more than ``crowd`` distinct fingerprints is not expanded into pairs. Its
fingerprints go an exact other way: two fingerprints lie within two bits if and
only if some value lies within one bit of both, so each is listed under its 65
values at distance 0 or 1, and all (at most 65) that meet there are linked to
the smallest. Both ways lose no link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import Scratch, batches, beside, fresh, table
from tallyforge.llm.shingles import majority, shingle_hashes, shingle_rows


def text_fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; 0 where it has no words.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer
    words than a shingle has is one shingle.
    """
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row, as a signed 64-bit integer."""

    def fold(texts: pd.Series) -> pd.Series:
        values = np.array([text_fingerprint(t, shingle_words) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(fold, T.LongType())(F.col(text_col)).alias("fp"))


def variant_keys(fp: str) -> F.Column:
    """The 64 one-wildcard segment variants of ``fp``, each as one integer."""
    return F.expr(
        f"transform(sequence(0, 63), i -> shiftleft(cast(i as bigint), 32) | "
        f"((case when i < 32 then shiftrightunsigned({fp}, 32) else {fp} & 4294967295L end) & ~shiftleft(1L, i % 32)))"
    )


def links(scratch: Scratch, distinct: DataFrame, crowd: int = 64) -> DataFrame:
    """Edges (a, b) between the ``rep`` of fingerprints within two bits that connect whatever all links connect.

    ``distinct``: (fp, rep), one row per fingerprint.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    # a small table would be one task, and 64 times as many rows leave it
    variants = distinct.repartition(parts, "fp").select("fp", "rep", F.explode(variant_keys("fp")).alias("key"))
    shared = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes both sides as if nothing were exploded, and would broadcast the variants of a small table
    members = scratch.save(variants.join(shared.hint("merge"), "key"), "members")
    few = members.where(F.col("n") <= crowd)
    left = few.select("key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    right = few.select("key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    pairs = left.join(right, "key").where("fp_a < fp_b and bit_count(fp_a ^ fp_b) <= 2").select("a", "b")
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    stars = (
        members.where(F.col("n") > crowd)
        .select("fp", "rep")
        .distinct()
        .select("rep", F.explode(near).alias("value"))
        .groupBy("value")
        .agg(F.collect_set("rep").alias("reps"))  # at most 65 fingerprints lie within one bit of a value
        .where(F.size("reps") > 1)
        .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    )
    return pairs.union(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, crowd: int = 64) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of two differing bits or fewer.

    Null and blank texts have fingerprint 0 and link like any other. Repeated
    rows keep a row each. Rows with a null id keep their fingerprint; their
    component is that of the others with it, null where there are none. Extra
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    with batches(scratch.spark):
        prints = scratch.save(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    found = connected_components(scratch, links(scratch, distinct.where("rep is not null"), crowd))
    classes = scratch.save(
        distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component")),
        "classes",
    )
    return prints.join(classes, "fp").select("id", "fp", "component")


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes of ``prints`` (node, fp) that fingerprints within two bits suggest."""
    scratch = Scratch(prints.sparkSession, "simhash")
    nodes = prints.select("node", "fp").distinct()
    distinct = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = nodes.join(distinct, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return equal.union(links(scratch, distinct))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) with one document of each group left, the smallest doc_id.

    Texts are linked where their five-word shingles have a similarity of 0.8 or
    more. SimHash finds the nearest of them by deletion variants; at 0.8 about
    ten of 64 bits differ, which no variants can index, so what it leaves apart
    is found through shingle prefixes (see ``shingles``). Every link is verified.

    Texts with the same words link, blank and null ones with each other. Of
    different texts of a group that share the smallest doc_id, one stays;
    documents of different groups stay, whatever their doc_ids. Of rows that
    repeat doc_id and text the one whose other columns come first as JSON stays.
    Rows with a null doc_id stay. Other columns may have any names and types. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = shingle_rows(scratch, docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), ahead=near_pairs)
    least = rows.groupBy("part").agg(F.min("id").alias("id"))
    first = rows.join(least, ["part", "id"]).groupBy("part", "id").agg(F.min("mark").alias("mark"), F.count("*").alias("times"))
    first = scratch.save(first, "first")
    key, mark, row, order = fresh(docs, "key", "mark", "row", "order")
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = lambda df: df.select(F.col("id").alias(key), F.col("mark").alias(mark))
    gone = scratch.save(named(rows.join(first, ["part", "id", "mark"], "left_anti").distinct()), "gone")
    again = scratch.save(named(rows.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1")).join(gone, [key, mark], "left_anti"), "again")
    scratch.drop("parts")
    told = docs.withColumn(key, F.col("doc_id")).withColumn(mark, F.xxhash64("text"))
    kept = told.join(beside(gone), [key, mark], "left_anti")
    if again.isEmpty():
        return kept.select(*own)
    rest = F.to_json(F.struct(*[c for c, name in zip(own, docs.columns) if name != "text"]))
    repeated = kept.join(beside(again), [key, mark], "left_semi").withColumn(order, rest).groupBy(key, mark).agg(F.min_by(F.struct(*own), order).alias(row))
    single = repeated.select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return kept.join(beside(again), [key, mark], "left_anti").select(*own).union(single)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
