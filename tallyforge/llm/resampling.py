"""Importance resampling towards a target corpus, in Spark's own functions.

Texts become bags of hashed n-grams. What a bucket gains is the logarithm of its
share in the target over its share in the corpus, both smoothed by one; a
document's weight is the sum over its features. Drawing without replacement in
proportion to the weights' exponentials is then taking the highest of weight
plus Gumbel noise, which a distributed sort ranks: each of its partitions counts
its rows, and a row's rank is its place there plus what the partitions before
hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, table

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what a word is, once A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and everything beyond ASCII, after A-Z are lower-cased; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def buckets_of(found: Column, grams: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``grams`` of the words ``found``, repeats included."""
    hashed = lambda w: (F.crc32(w) % buckets).cast("int")

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - k + 1)
        listed = F.transform(starts, lambda i: hashed(F.array_join(F.slice(found, i, k), " ")))
        return F.when(F.size(found) >= k, listed).otherwise(F.array().cast("array<int>"))

    single = F.transform(found, hashed)
    return single if grams == 1 else F.concat(single, *map(runs, range(2, grams + 1)))


def features(rows: DataFrame, grams: int, buckets: int) -> DataFrame:
    """``rows`` (..., text) with n_words and the array ``buckets`` in place of the text."""
    told = rows.withColumn("found", words(F.col("text"))).drop("text")
    return told.select(*[c for c in told.columns if c != "found"], F.size("found").alias("n_words"), buckets_of(F.col("found"), grams, buckets).alias("buckets"))


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) of rows with ``buckets``; counts are combined before they are shuffled."""
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that the corpus has, from two counts (bucket, n): at most ``buckets`` rows, in thousandths."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s, t = total(corpus), total(target)
    real = lambda c: c.cast("double")
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    share = (real(F.coalesce("t", F.lit(0))) + 1) * F.lit(float(s + buckets)) / ((real(F.col("s")) + 1) * F.lit(float(t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def ranked(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first in ``order``: a distributed sort, then the counts of the partitions before."""
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row's place in it in the lower 33
    placed = scratch.save(rows.orderBy(*order).withColumn("_at", at), name).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    rank = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", rank).drop("_at", "_part", "_start")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; ``target`` has a column ``text``.

    Counts are of all rows of both. Documents of ``least_words`` words or more
    may be drawn; of N such, the floor(N x percent / 100) with the highest scores
    have a rank, ties to the smaller id, then by their order in ``docs``; null
    ids come last among equals. Null and empty texts have no features and weight
    0. A null id draws its noise as an empty one, so rows that repeat an id
    differ by their weights alone. Other columns are ignored, whatever their
    names. An empty corpus gives an empty result; with an empty target all
    gains are those of a target without words.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    quoted = lambda c: F.col(f"`{c}`")
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    bags = scratch.save(features(rows, grams, buckets), "bags")
    counts = scratch.save(bucket_counts(bags), "counts")
    gain = gains(counts, bucket_counts(features(target.select("text"), grams, buckets)), buckets)
    met = bags.select("place", "id", "n_words", F.size("buckets").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = met.join(F.broadcast(gain), "bucket", "left").groupBy("place", "id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    weighed = scratch.save(summed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weighed")
    may = weighed.where(F.col("n_words") >= least_words)
    drawn = may.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place")]
    sure = ranked(scratch, may, order, "ordered").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return sure.unionByName(rest).select("id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def _sql_bags(name: str, also: str = "") -> str:
    return f"SELECT {also} regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS found FROM {name}"


# crc32 by its table of 256 remainders, over the bytes of each distinct word
SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
docs AS ({_sql_bags('documents', 'doc_id, row_number() OVER () AS id,')}),
wanted AS ({_sql_bags('benchmark')}),
said AS (SELECT unnest(found) AS word, id FROM docs),
sought AS (SELECT unnest(found) AS word FROM wanted),
bucket AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM (SELECT word FROM said UNION SELECT word FROM sought), step),
s AS (SELECT bucket, count(*) AS n FROM said JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM sought JOIN bucket USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + {BUCKETS}.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}.0::DOUBLE)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT id, sum(gain) AS weight FROM said JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY id),
w AS (SELECT d.doc_id, len(d.found) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs d LEFT JOIN sums ON sums.id = d.id),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * {PERCENT} // 100 THEN place END AS rank FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {LEAST_WORDS}
"""

QUERIES = {"op12_resampling": op12_resampling}
ORACLES = {"op12_resampling": SQL}
