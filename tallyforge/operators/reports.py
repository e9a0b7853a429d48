"""Aggregations behind the reports. Amounts are summed as decimals, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import ranks

MONEY = "decimal(18,4)"


def money(c: Column, kind: str = MONEY) -> Column:
    """The exact sum of ``c``, 0 of nothing."""
    return F.coalesce(F.sum(c.cast(kind)).cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double")) * F.lit(scale)


def median_of(df: DataFrame, value: str) -> DataFrame:
    """One row: the exact median, null of nothing."""
    return ranks.medians(df, [], value).agg(F.max("median").alias("median"))


def overview(df: DataFrame, month: str, amount: str, is_refund: Column) -> DataFrame:
    """One row of totals; the average and the median are of refunds only, months without ``unknown``."""
    refund = F.when(is_refund, F.col(amount))
    totals = df.agg(
        F.count("*").alias("tickets"),
        F.count_if(is_refund).alias("refunds"),
        money(refund).alias("refund_value"),
        F.countDistinct(F.when(F.col(month) != "unknown", F.col(month))).alias("months"),
    )
    middle = median_of(df.where(is_refund), amount)
    return totals.crossJoin(middle).select(  # one row each
        "tickets", "refunds", "refund_value", "months", F.col("median").alias("median_refund"),
        ratio(F.col("refund_value"), F.col("refunds")).alias("average_refund"),
        ratio(F.col("refunds"), F.col("tickets"), 100).alias("refund_rate_pct"),
        (ratio(F.col("refund_value"), F.col("months")) * 3).alias("value_per_quarter"),
    )


def monthly(df: DataFrame, month: str, amount: str, is_refund: Column, avoidable: Column, score: str | None = None) -> DataFrame:
    """Totals by month in one aggregate. A month without scores has none: blanks are not zeros."""
    extra = [F.avg(F.col(score).cast("double")).alias("score_mean")] if score else []
    return df.groupBy(month).agg(
        F.count("*").alias("tickets"), F.count_if(is_refund).alias("refunds"),
        money(F.when(is_refund, F.col(amount))).alias("refund_value"), money(F.when(is_refund, avoidable)).alias("avoidable_value"), *extra,
    ).withColumn("refund_rate_pct", ratio(F.col("refunds"), F.col("tickets"), 100))


def trend_halves(by_month: DataFrame, month: str = "month") -> DataFrame:
    """One row: growth from the first half of the months to the second (an odd one counts to the second); null below four months.

    Reads one row per month, so the ordering over all of them is small.
    """
    ranked = by_month.withColumn("_k", F.row_number().over(Window.orderBy(month))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    halves = ranked.withColumn("_h", F.when(F.col("_k") <= F.floor(F.col("_n") / 2), 1).otherwise(2))

    def half(c: str, h: int) -> Column:
        return F.sum(F.when(F.col("_h") == h, F.col(c)))

    t = halves.agg(*[half(c, h).alias(f"{c}_{h}") for c in ("tickets", "refunds", "refund_value") for h in (1, 2)], F.max("_n").alias("months"))
    grow = lambda f: ratio(f(2), f(1))
    tickets, value = lambda h: F.col(f"tickets_{h}"), lambda h: F.col(f"refund_value_{h}")
    rate, size = lambda h: ratio(F.col(f"refunds_{h}"), tickets(h)), lambda h: ratio(value(h), F.col(f"refunds_{h}"))
    enough = F.col("months") >= 4
    out = {"ticket_growth": grow(tickets), "value_growth": grow(value), "rate_growth": grow(rate), "size_growth": grow(size)}
    share = F.when(F.abs(out["value_growth"] - 1) > 1e-6, ratio(out["ticket_growth"] - 1, out["value_growth"] - 1))
    return t.select("months", *[F.when(enough, c).alias(n) for n, c in out.items()], F.when(enough, share).alias("volume_share"))


def by_reason(refunds: DataFrame, reason: Column, amount: str) -> DataFrame:
    """Count, value and share of value by reason; blank reasons are one group of their own."""
    rows = refunds.groupBy(F.coalesce(F.when(reason != "", reason), F.lit("(blank)")).alias("reason")).agg(F.count("*").alias("refunds"), money(F.col(amount)).alias("value"))
    whole = rows.agg(F.sum(F.col("value").cast(MONEY)).cast("double").alias("_all"))
    return rows.crossJoin(whole).select("reason", "refunds", "value", ratio(F.col("value"), F.col("_all"), 100).alias("share_pct"))  # by one row


def agreement(refunds: DataFrame, source: Column, expected: Column) -> DataFrame:
    """One row: how often the source code is what the normalised reason implies, over rows that have both."""
    both = source.isNotNull() & (source != "") & expected.isNotNull()
    n, same = F.count_if(both), F.count_if(both & (source == expected))
    return refunds.agg(n.alias("compared"), same.alias("agree")).withColumn("agreement_pct", ratio(F.col("agree"), F.col("compared"), 100))


def default_code(refunds: DataFrame, source: Column, default: str, reason: Column, amount: str) -> DataFrame:
    """What hides behind the default code: count, value and share of the default's rows by normalised reason."""
    rows = refunds.where(source == default).groupBy(reason.alias("reason")).agg(F.count("*").alias("refunds"), money(F.col(amount)).alias("value"))
    whole = rows.agg(F.sum("refunds").alias("_all"))
    return rows.crossJoin(whole).select("reason", "refunds", "value", ratio(F.col("refunds"), F.col("_all"), 100).alias("share_pct"))  # by one row


def by_agent(df: DataFrame, agent: str, amount: str, is_refund: Column, roster: DataFrame, roster_key: str, peer: Column) -> DataFrame:
    """Per agent: tickets, refunds, value, refunds and value per 100 tickets, and the peer group from the roster."""
    rows = df.groupBy(agent).agg(F.count("*").alias("tickets"), F.count_if(is_refund).alias("refunds"), money(F.when(is_refund, F.col(amount))).alias("value"))
    named = roster.select(F.col(roster_key).alias(agent), peer.alias("peer_group"))
    return rows.join(named, agent, "left").select(
        agent, F.coalesce("peer_group", F.lit("(unknown)")).alias("peer_group"), "tickets", "refunds", "value",
        ratio(F.col("refunds"), F.col("tickets"), 100).alias("refunds_per_100"), ratio(F.col("value"), F.col("tickets"), 100).alias("value_per_100"),
    )


def against_peers(agents: DataFrame, measure: str, peer: str = "peer_group") -> DataFrame:
    """``agents`` with their peer group's median and the difference to it."""
    middle = agents.groupBy(peer).agg(F.median(measure).alias("peer_median"))
    return agents.join(middle, peer).withColumn("variance", F.col(measure) - F.col("peer_median"))


def peer_summary(agents: DataFrame, measure: str, peer: str = "peer_group") -> DataFrame:
    return agents.groupBy(peer).agg(
        F.count("*").alias("agents"), F.min(measure).alias("least"), F.median(measure).alias("median"), F.max(measure).alias("most"),
        F.bool_and(F.col("tickets") >= 30).alias("all_comparable"),
    )


def by_team(refunds: DataFrame, team: str, amount: str) -> DataFrame:
    """Value and shares by team; rows without a team are left out but stay in the shares' denominators."""
    rows = refunds.groupBy(team).agg(F.count("*").alias("refunds"), money(F.col(amount)).alias("value"))
    whole = rows.agg(F.sum("refunds").alias("_n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("_v"))
    return rows.crossJoin(whole).where(F.col(team).isNotNull()).select(  # by one row
        team, "refunds", "value", ratio(F.col("refunds"), F.col("_n"), 100).alias("refund_share_pct"), ratio(F.col("value"), F.col("_v"), 100).alias("value_share_pct")
    )


def by_driver(refunds: DataFrame, drivers: str, avoidable: str) -> DataFrame:
    """Per driver: refunds, gross value (each refund whole, so rows add up to more) and pro-rated value (adds up to the total)."""
    each = refunds.where(F.size(drivers) > 0).select(F.explode(drivers).alias("driver"), F.col(avoidable).alias("_v"), F.size(drivers).alias("_n"))
    return each.groupBy("driver").agg(F.count("*").alias("refunds"), money(F.col("_v")).alias("gross_value"), money(F.col("_v") / F.col("_n"), "decimal(24,10)").alias("prorated_value"))


def lot_scores(df: DataFrame, lot: list[str], is_refund: Column, least: int = 30) -> DataFrame:
    """One-sample z of each lot's refund rate against the overall rate, for lots of at least ``least`` tickets.

    The cut-off is 2.5758 where more than 20 lots are tested, else 1.96; only
    rates above the overall one can be significant.
    """
    rows = df.groupBy(*lot).agg(F.count("*").alias("tickets"), F.count_if(is_refund).alias("refunds"))
    overall = rows.agg(ratio(F.sum("refunds"), F.sum("tickets")).alias("_p"), F.count_if(F.col("tickets") >= least).alias("_k"))
    rate = ratio(F.col("refunds"), F.col("tickets"))
    z = F.try_divide(rate - F.col("_p"), F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("tickets")))
    scored = rows.where(F.col("tickets") >= least).crossJoin(overall).withColumn("z_score", z)  # by one row
    return scored.select(*lot, "tickets", "refunds", (rate * 100).alias("refund_rate_pct"), "z_score", (F.col("z_score") > F.when(F.col("_k") > 20, 2.5758).otherwise(1.96)).alias("significant"))


def walk(steps: list[tuple[str, DataFrame, str]], months: int) -> DataFrame:
    """Totals after each step with the change from the one before, and the value per quarter. A row per step."""
    rows = None
    for i, (name, df, amount) in enumerate(steps):
        one = df.where(F.col(amount).isNotNull()).agg(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.count("*").alias("rows"), money(F.col(amount)).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    order = Window.orderBy("step")
    return rows.withColumn("delta", F.col("value") - F.lag("value").over(order)).withColumn("per_quarter", F.col("value") / months * 3)


def opportunity(total: Column, months: Column) -> Column:
    """struct(per_month, per_quarter, per_year, save_25_pct, save_50_pct); zeros without months."""
    by_month = F.when(months > 0, total / months).otherwise(0.0)
    quarter = by_month * 3
    named = {"per_month": by_month, "per_quarter": quarter, "per_year": by_month * 12, "save_25_pct": quarter * 0.25, "save_50_pct": quarter * 0.5}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def call_costs(calls: DataFrame, by: list[str], tokens_in: str, tokens_out: str, upstream: Column, rates: tuple[float, float], fx: float) -> DataFrame:
    """Calls, tokens and cost by group; an upstream cost counts before the estimate."""
    estimate = F.col(tokens_in) * rates[0] / 1e6 + F.col(tokens_out) * rates[1] / 1e6
    cost = F.coalesce(upstream, estimate)
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum(cost.cast("decimal(24,10)")), F.lit(0)).cast("double").alias("cost"),
    ).withColumn("cost_local", F.col("cost") * fx)


def reasons(refunds: DataFrame, reason: Column, amount: str, source: Column, expected: Column, label: Column, avoidable: str) -> DataFrame:
    """Per reason: count, value, their shares of the refunds in scope, average, what is avoidable, and how often the source code is the one to be expected.

    Refunds without a reason are out of scope. A reason without an expected code
    has no agreement, nor has one whose refunds all lack a source code. The
    shares' denominators are 1 at least.
    """
    avoid = label == "POTENTIALLY_AVOIDABLE"
    coded = source.isNotNull() & expected.isNotNull()
    rows = refunds.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(
        F.count("*").alias("refunds"), money(F.col(amount)).alias("value"), F.count_if(avoid).alias("avoidable"), money(F.when(avoid, F.col(avoidable))).alias("avoidable_value"),
        F.max(expected).alias("expected_code"), ratio(F.count_if(coded & (source == expected)), F.count_if(coded), 100).alias("agreement_pct"),
    )
    whole = rows.agg(F.sum("refunds").alias("_n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("_v"))
    at_least = lambda c: F.greatest(F.lit(1.0), F.col(c).cast("double"))
    return rows.crossJoin(whole).select(  # by one row
        "reason", "refunds", "value", ratio(F.col("refunds"), at_least("_n"), 100).alias("count_share_pct"), ratio(F.col("value"), at_least("_v"), 100).alias("value_share_pct"),
        ratio(F.col("value"), F.col("refunds")).alias("average"), "avoidable", "avoidable_value", "expected_code", "agreement_pct",
    )


def miscoding(refunds: DataFrame, source: Column, default: str, reason: Column, expected: Column, amount: str) -> DataFrame:
    """One row: refunds and value under the default code with their shares, and how many classified refunds carry the code to be expected."""
    on = F.coalesce(source == default, F.lit(False))
    both = reason.isNotNull() & expected.isNotNull() & source.isNotNull() & (source != "")
    row = refunds.agg(
        F.count("*").alias("refunds"), F.count_if(on).alias("on_default"), money(F.when(on, F.col(amount))).alias("on_default_value"), money(F.col(amount)).alias("_v"),
        F.count_if(both).alias("comparable"), ratio(F.count_if(both & (source == expected)), F.count_if(both), 100).alias("agreement_pct"),
        F.count_if(on & both & (reason == "GOODWILL_GESTURE")).alias("genuine_goodwill"),
    )
    at_least = lambda c: F.greatest(F.lit(1.0), F.col(c).cast("double"))
    return row.select(
        "refunds", "on_default", ratio(F.col("on_default"), at_least("refunds"), 100).alias("on_default_pct"), "on_default_value",
        ratio(F.col("on_default_value"), at_least("_v"), 100).alias("on_default_value_pct"), "comparable", "agreement_pct", "genuine_goodwill",
    )


def cost_summary(calls: DataFrame, fx: float, classified: int, refunds: int, tickets: int, per_week: int) -> DataFrame:
    """One row on calls (tokens_in, tokens_out, cost, upstream, latency_ms, status, retries, cache_hit): totals, averages, and the month's cost projected.

    What the provider reported counts before the estimate. Without calls the
    counts are zero and nothing else is told.
    """
    c = F.col
    row = calls.agg(
        F.count("*").alias("calls"), F.count_if(c("status") == "success").alias("succeeded"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        money(c("cost"), "decimal(24,10)").alias("_estimate"), money(c("upstream"), "decimal(24,10)").alias("_upstream"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.count_if(c("cache_hit")).alias("cache_hits"),
    )
    row = row.withColumn("cost", F.when(c("_upstream") > 0, c("_upstream")).otherwise(c("_estimate"))).withColumn("cost_local", c("cost") * fx)
    each = F.when(F.lit(classified > 0), c("cost_local") / max(1, classified)).otherwise(ratio(c("cost_local"), c("calls")))
    share, month = refunds / tickets if tickets else 0.0, per_week * 52 / 12
    some = lambda x: F.when(c("calls") > 0, x)
    return row.select(
        "calls", "succeeded", (c("calls") - c("succeeded")).alias("failed"), "tokens_in", "tokens_out", ratio(c("tokens_in"), c("calls")).alias("mean_tokens_in"), ratio(c("tokens_out"), c("calls")).alias("mean_tokens_out"),
        "mean_latency_ms", "retries", "cache_hits", ratio(c("cache_hits"), c("calls")).alias("cache_hit_rate"), some(c("cost")).alias("cost"), some(c("cost_local")).alias("cost_local"), some(each).alias("cost_each"),
        some(each * month).alias("month_all"), some(each * month * share).alias("month_refunds"),
    )
