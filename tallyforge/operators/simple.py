"""The flat variant of the desk's pipeline, with its own, simpler rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import decisions, quality, temporal

LEGACY = "legacy_fd"


def clean_refund(amount: Column, system: Column, divisor: int = 100) -> Column:
    """Nothing and less is 0; amounts of the legacy system, however it is written, are divided."""
    return F.when(amount.isNull() | (amount <= 0), 0.0).when(F.lower(system) == LEGACY, amount / divisor).otherwise(amount)


def latest_values(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key the last non-null value of each column in ``order``; columns may come from different rows."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def flatten(tickets: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, agents: DataFrame) -> DataFrame:
    """One wide row per ticket: cleaned money, helpdesk copy first, times, service level, four lookups, flags.

    Every lookup is renamed before it is joined, so a customer's name never
    passes for an agent's. Of repeated order ids the first read counts.
    """
    system = F.col("source_system")
    shift = F.expr("interval '5:30' hour to minute")
    money = tickets.withColumn("clean_refund", clean_refund(F.col("amount"), system))
    single = quality.dedupe_by_preference(money, ["ticket_id"], [F.when(system == "helpdesk", 0).otherwise(1), F.col("ordinal")])
    timed = single.withColumn("resolved_at", F.when(system == LEGACY, F.col("resolved_at") + shift).otherwise(F.col("resolved_at")))
    timed = timed.withColumn("month", temporal.month_key(F.col("created_at")))
    timed = timed.withColumn("handle_hours", temporal.minutes_between(F.col("created_at"), F.col("resolved_at")) / 60)
    timed = timed.withColumn("first_response_minutes", temporal.minutes_between(F.col("created_at"), F.col("first_response_at")))
    target = F.coalesce(*[F.when(F.col("channel") == k, F.lit(float(v))) for k, v in decisions.SLA_MINUTES.items()], F.lit(480.0))
    timed = timed.withColumn("sla_breached", F.coalesce(F.col("first_response_minutes") > target, F.lit(False)))
    first_order = quality.dedupe_by_preference(orders.withColumn("_o", F.monotonically_increasing_id()), ["order_id"], [F.col("_o")]).drop("_o", "duplicate_row_count")
    named = lambda df, key, prefix: df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])
    latest = latest_values(agents, "agent_id", ["from_date"], [c for c in agents.columns if c != "agent_id"])
    wide = (
        timed.join(named(first_order, "order_id", "order"), "order_id", "left")
        .join(named(customers, "customer_id", "customer"), "customer_id", "left")
        .join(named(products.withColumnRenamed("sku", "product_sku"), "product_sku", "product"), "product_sku", "left")
        .join(named(latest, "agent_id", "agent"), "agent_id", "left")
    )
    refund = F.col("clean_refund") > 0
    wide = wide.withColumn("is_refund", refund).withColumn("is_dual_remedy", refund & F.coalesce(F.col("replacement_issued"), F.lit(False)))
    return wide.withColumn("avoidability", decisions.avoidability_simple(F.col("clean_refund"), F.col("replacement_issued"), F.col("source_reason_code")))
