"""Tickets that arrive as files, folded into monthly totals as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.reports import money
from tallyforge.sources.files import FILES, to_number, to_stamp


def ticket_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New ticket files of a folder, typed; each ticket of a source system once within the watermark."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FILES["tickets"]])
    raw = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    typed = raw.withColumn("created_at", to_stamp(F.col("created_at")).cast("timestamp")).withColumn("amount", to_number(F.col("refund_amount_inr")))
    return typed.withWatermark("created_at", "7 days").dropDuplicatesWithinWatermark(["ticket_id", "source_system"])


def daily_totals(tickets: DataFrame) -> DataFrame:
    """Tickets, refunds and value by day of creation; a day closes when the watermark has passed it."""
    return tickets.groupBy(F.window("created_at", "1 day").alias("day")).agg(F.count("*").alias("tickets"), F.count("amount").alias("refunds"), money(F.col("amount")).alias("refund_value")).select(F.col("day.start").alias("day"), "tickets", "refunds", "refund_value")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
