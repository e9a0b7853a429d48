"""Exact duplicates by a distributed sort of contents, in DataFrame functions only.

Splitters, drawn from a sample, cut the order of normalised bytes into ranges.
A row goes to its range by bisection, one range is one partition, and an
external sort in it places equal texts next to each other. Neighbours are then
compared in full; a run of equal ones is a group.

The order is that of a bounded *front* (the first bytes and a 64-bit hash), then
the text, so splitters stay small however long texts are. A splitter also holds
a salt of the row, so a text with a large part of all rows lies in as many
ranges as its rows need. Only texts whose front a splitter has can lie in two
ranges. Their runs, at most one for each range and text, are put together by
their texts, compared in full again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, beside, table

#: Bytes of a text that its front holds.
FRONT = 32
#: Sampled rows for each range, and at all: they set how even the ranges are, never the result.
_PER_RANGE, _SAMPLED = 64, 400_000
_HEX = 16  # digits of 64 bits


def unchanged(text: Column) -> Column:
    return text


def folded(text: Column) -> Column:
    """A-Z lower-cased, runs of ASCII white space as one space, none at the ends."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def _front(text: Column) -> Column:
    """Sorts as the first bytes of ``text`` do, then by its hash; of one length for all texts."""
    head = F.rpad(F.hex(F.substring(text.cast("binary"), 1, FRONT)), 2 * FRONT, "0")
    return F.concat(head, F.lpad(F.hex(F.xxhash64(text)), _HEX, "0"))


def _splitters(rows: DataFrame, ranges: int) -> list[str]:
    """Fronts with salts that cut ``rows`` (text, salt) into about ``ranges`` ranges of like size in bytes."""
    n = rows.count()
    wanted = min(_SAMPLED, _PER_RANGE * ranges)
    drawn = rows if n <= wanted else rows.where(F.pmod("salt", F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
    place = F.concat(_front(F.col("text")), F.lpad(F.hex("salt"), _HEX, "0"))
    found = sorted(drawn.select(place.alias("place"), F.octet_length("text").alias("size")).collect())
    ends = list(accumulate(r["size"] + 200 for r in found))
    cuts = {bisect_left(ends, ends[-1] * k / ranges) for k in range(1, ranges)} if found else set()
    return sorted({found[i]["place"] for i in cuts})


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = unchanged, largest: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256 and, with ``carry``, carried): one row for each row of ``docs``.

    Texts are equal when their normalised texts are, byte by byte; a null text is
    empty, so null and empty texts are one group. The row with the smallest id
    stays (``largest``: the largest), of rows that repeat it the first in the
    order of ``docs``: one row of every group is ``kept``. A null id stays only
    where a group has no other; keep_id is null then. text_sha256 is of the
    normalised text. ``carried`` is a struct of the columns in ``carry``, of any
    names and types. An empty table gives an empty result.

    ``docs`` should be read from files: rows that are equal throughout are told
    apart by their place in it, which a lost executor's work has to find again.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quoted = lambda c: F.col(f"`{c}`")
    carried = [F.struct(*map(quoted, carry)).alias("carried")] if carry else []
    text = normalise(F.coalesce(quoted(text_col), F.lit("")))
    named = docs.select(quoted(id_col).alias("id"), text.alias("text"), *carried, F.monotonically_increasing_id().alias("place")).withColumn("salt", F.xxhash64("id", "place"))
    splitters = _splitters(named.select("text", "salt"), ranges)
    listed = F.split(F.lit(",".join(splitters)), ",") if splitters else F.array().cast("array<string>")
    whole = F.concat("front", F.lpad(F.hex("salt"), _HEX, "0"))
    powers = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    reach = F.lit(len(splitters))
    below = F.lit(0)  # splitters at or before a row, by bisection
    if powers:
        below = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda k, p: F.when((k + p <= reach) & (F.get(listed, k + p - 1) <= whole), k + p).otherwise(k))
    front_at = lambda k: F.substring(F.get(listed, k), 1, 2 * FRONT + _HEX)
    told = named.withColumn("front", _front(F.col("text"))).withColumn("range", below)
    crosses = F.coalesce(front_at(F.col("range") - 1) == F.col("front"), F.lit(False)) | F.coalesce(front_at(F.col("range")) == F.col("front"), F.lit(False))
    dealt = told.withColumn("crosses", crosses).repartitionById(len(splitters) + 1, F.col("range"))

    scratch = Scratch(spark, "exact")
    # the window sorts by its keys, so equal texts are neighbours, and takes the next row as of the same run if all keys are equal
    run = Window.partitionBy("range", "front", "text")
    best = F.max if largest else F.min
    absent = F.col("id").isNull()
    order = F.struct((~absent if largest else absent).alias("side"), F.col("id").alias("id"), (-F.col("place") if largest else F.col("place")).alias("place"))
    runs = dealt.withColumns({"size": F.count("*").over(run), "best": best(order).over(run), "run": F.min("place").over(run)})
    held = F.when(F.col("crosses") & (F.col("run") == F.col("place")), F.col("text"))
    ordered = scratch.save(runs.select("id", *["carried"] * bool(carry), "place", "size", "best", "run", F.sha2("text", 256).alias("text_sha256"), held.alias("held")), "ordered")

    # a text in several ranges: its runs have one row each here
    over = ordered.where("held is not null").groupBy("held").agg(F.sum("size").alias("all"), best("best").alias("first"), F.collect_set("run").alias("runs")).where(F.size("runs") > 1)
    joined = scratch.save(over.select(F.explode("runs").alias("run"), "all", "first"), "joined")
    out = ordered.join(beside(joined), "run", "left").withColumn("first", F.coalesce("first", "best"))
    mine = F.col("first.place") == (-F.col("place") if largest else F.col("place"))
    return out.select("id", F.col("first.id").alias("keep_id"), F.coalesce("all", "size").alias("group_size"), mine.alias("kept"), "text_sha256", *["carried"] * bool(carry))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = unchanged, largest: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts left, as ``exact_groups`` says; all columns stay, whatever their names."""
    kept = exact_groups(docs, id_col, text_col, normalise, largest, docs.columns).where("kept")
    return kept.select(*[F.col("carried")[c].alias(c) for c in docs.columns])


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), largest=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
WINDOW same AS (PARTITION BY text)
"""

QUERIES = {"op11_exact": op11_exact}
ORACLES = {"op11_exact": SQL}
