"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes cuts the text wherever its low bits are all set,
so cuts follow the content and survive edits elsewhere. Every chunk gives one
base-64 digit; the fingerprint is ``block:digits:digits at twice the block``.
The block size is the largest power of two that gives at least 32 digits of the
expected 64 or so. All chunks are in the fingerprint, however many: equal chunks
in a row are one digit, followed by ``*`` and their number, so a text of one line
over and over has a short signature that tells how often. Two fingerprints are
compared by edit distance, over whole signatures, where their block sizes are
equal or differ by a factor of two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import table

WINDOW = 7
#: Runs of chunks that a block size should give at most; where the next one has less than half as many cuts, it gives more.
DIGITS = 64
LEAST_BLOCK = 4
_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_FACTORS = [pow(0x01000193, k, 1 << 32) for k in range(WINDOW)]


def _digit(sums: np.ndarray) -> np.ndarray:
    return _BASE64[((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.intp)]


def _number(n: int) -> str:
    """A whole number in base 64, the highest digit first."""
    out = ""
    while n:
        n, digit = divmod(n, 64)
        out = chr(_BASE64[digit]) + out
    return out


def _runs(mixed: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each run of equal chunks, and how many it has; chunks end after ``cuts``."""
    starts = np.concatenate(([0], cuts + 1))
    sums = np.add.reduceat(mixed, starts[starts < len(mixed)])
    begins = np.flatnonzero(np.concatenate(([True], sums[1:] != sums[:-1])))
    return sums[begins], np.diff(np.append(begins, len(sums)))


def _digits(mixed: np.ndarray, cuts: np.ndarray) -> str:
    """A digit for each run of equal chunks, with its length from two on."""
    sums, times = _runs(mixed, cuts)
    digits = _digit(sums).tobytes().decode()
    if times.max() == 1:
        return digits
    return "".join(d if n == 1 else f"{d}*{_number(int(n))}" for d, n in zip(digits, times))


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    plain = data.astype(np.uint32) + np.uint32(1)
    rolled = plain.copy()
    for k in range(1, min(WINDOW, len(data))):
        rolled[k:] += plain[:-k] * np.uint32(_FACTORS[k])
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    mixed = rolled.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    block = LEAST_BLOCK
    while block * DIGITS < len(data):
        block *= 2
    cuts = np.flatnonzero((rolled & np.uint32(block - 1)) == block - 1)
    while len(cuts) < DIGITS // 2 and block > LEAST_BLOCK:
        block //= 2
        cuts = np.flatnonzero((rolled & np.uint32(block - 1)) == block - 1)
    while len(_runs(mixed, cuts)[0]) > DIGITS and len(fewer := cuts[(rolled[cuts] & np.uint32(2 * block - 1)) == 2 * block - 1]) >= DIGITS // 2:
        block, cuts = 2 * block, fewer
    wider = cuts[(rolled[cuts] & np.uint32(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{_digits(mixed, cuts)}:{_digits(mixed, wider)}"


def edited(text: str | None, other: str | None) -> str:
    """The text whose last third of code points is replaced by the first as many (or all) of ``other``."""
    text, other = text or "", other or ""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance by the longer signature, at the block size that both have; 0 without one."""
    part = lambda x, k: F.split_part(x, F.lit(":"), F.lit(k))
    size = lambda x: part(x, 1).cast("long")

    def near(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 0.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    return (
        F.when(a == b, 1.0)
        .when(size(a) == size(b), near(part(a, 2), part(b, 2)))
        .when(size(a) == 2 * size(b), near(part(a, 2), part(b, 3)))
        .when(2 * size(a) == size(b), near(part(a, 3), part(b, 2)))
        .otherwise(0.0)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, its edited text's, and the next document's, in descending order of doc_id.

    Rows are dealt to ranges of doc_id whose first ids are real ones; a range's
    first document is also sent to the range before it (the very first to the
    last), so that every row meets its successor in one sorted pass. Ties of
    doc_id follow in descending order of text; null doc_ids come last. Null
    texts are empty. A single row is its own next. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20_000).alias("cuts")).first()
    heads = [] if cut["top"] is None else [cut["top"], *sorted({c for c in cut["cuts"] or [] if c < cut["top"]}, reverse=True)]
    if heads:
        after = F.array(*[F.lit(h) for h in heads[1:]]) if heads[1:] else F.array().cast("array<bigint>")
        own = F.when(F.col("doc_id").isNull(), len(heads) - 1).otherwise(F.size(F.filter(after, lambda h: F.col("doc_id") <= h)))
        is_head = F.array_contains(F.array(*[F.lit(h) for h in heads]), F.col("doc_id"))
    else:
        own, is_head = F.lit(0), F.lit(True)
    before = F.pmod(F.col("part") - 1, F.lit(max(1, len(heads)))).cast("int")
    both = F.when(F.coalesce(is_head, F.lit(False)), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("lent")), F.struct(before.alias("part"), F.lit(True).alias("lent"))))
    dealt = rows.withColumn("part", own.cast("int")).withColumn("to", F.explode(F.coalesce(both, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("lent")))))).select("doc_id", "text", "to.part", "to.lent")
    ordered = dealt.repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        last = None  # (doc_id, text, fingerprint) that waits for its next
        for batch in batches:
            out = []
            for doc, text, lent in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["lent"]):
                if lent and last is None:
                    continue
                own = fingerprint(text)
                if last is not None:
                    changed = edited(last[1], text)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last[2], fingerprint(changed), own))
                last = None if lent else (doc, text, own)
            if out:
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"doc_id": "Int64"})

    return ordered.mapInPandas(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLES: dict[str, str] = {}
