import time

from pyspark.sql import functions as F

from tallyforge.scratch import Scratch


def test_what_a_saved_table_shuffled_goes_at_once(spark):
    """Not only when the driver happens to collect its garbage; the session's own setting stays."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shuffled = lambda: {name for f in str(env.blockManager().diskBlockManager().getAllFiles().mkString("\n")).split("\n") if (name := f.rpartition("/")[2]).startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(name), shuffled()
    saved = Scratch(spark, "test").save(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffled() - there):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == before
    assert sorted(r["count"] for r in saved.collect()) == [1428] * 3 + [1429] * 4
