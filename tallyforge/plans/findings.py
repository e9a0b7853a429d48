"""What the data shows about itself: one ledger of findings with what they affect and what they rest on.

Each table is aggregated once, into one wide row that holds the counts, values
and nested evidence of all findings on it; the rows are put side by side and
unpivoted into one row a finding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import quality
from tallyforge.operators.reports import money, ratio

SOP = r"SOP\s*[\d.]+"
_SAMPLE = 10


@dataclass
class Finding:
    """Columns over the wide row; ``value`` and ``evidence`` may be left out."""

    finding_id: str
    severity: Column | str
    rows: Column
    value: Column | None = None
    evidence: dict[str, Column] | None = None


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """One row from several of one row each."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)  # one row each
    return out


def unpivoted(wide: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    """(finding_id, severity, affected_rows, affected_value, evidence): a row for each finding; evidence is a JSON object."""
    cells = []
    for f in findings:
        severity = F.lit(f.severity) if isinstance(f.severity, str) else f.severity
        value = F.lit(None) if f.value is None else F.round(f.value, 2)
        proof = F.to_json(F.struct(*[c.alias(k) for k, c in (f.evidence or {}).items()]), {"ignoreNullFields": "false"}) if f.evidence else F.lit("{}")
        cells += [F.lit(f.finding_id), severity, f.rows.cast("long"), value.cast("double"), proof]
    return wide.select(F.stack(F.lit(len(findings)), *cells).alias("finding_id", "severity", "affected_rows", "affected_value", "evidence"))


def of_raw(raw: DataFrame, system: str, amount: str, legacy: str, divisor: int) -> DataFrame:
    """One row: the export's total as it is, in one unit, and its legacy part."""
    is_legacy, unit = F.col(system) == legacy, F.col(amount) / divisor
    return raw.agg(
        F.count(amount).alias("raw_refunds"),
        money(F.col(amount)).alias("raw_total"),
        money(F.when(is_legacy, unit).otherwise(F.col(amount))).alias("unit_total"),
        F.count(F.when(is_legacy, F.col(amount))).alias("legacy_refunds"),
        money(F.when(is_legacy, unit)).alias("legacy_total"),
    )


def of_tickets(tickets: DataFrame) -> DataFrame:
    """One row on single tickets."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    months = F.countDistinct(F.when(F.col("month") != "unknown", F.col("month")))
    links = ("quoted", "fallback_unique", "fallback_nearest", "unresolved")
    return tickets.agg(
        F.count("*").alias("tickets"),
        money(F.col("amount")).alias("single_total"),
        count(F.col("is_refund")).alias("single_refunds"),
        months.alias("months"),
        count(F.col("duplicate_row_count") > 1).alias("duplicated_ids"),
        F.coalesce(F.sum(F.col("duplicate_row_count") - 1), F.lit(0)).alias("redundant_rows"),
        count(F.col("order_id_source").isNull()).alias("without_order"),
        F.struct(*[count(F.col("order_link") == k).alias(k) for k in links]).alias("order_links"),
        count(F.col("is_refund") & ~F.col("is_attendance")).alias("refund_on_open"),
        count(F.col("days_since_order") < 0).alias("before_order"),
        count(F.col("csat_score").isNull()).alias("without_score"),
        count(text.matches(F.col("agent_notes"), SOP)).alias("sop_cited"),
        count(F.col("source_system") == "legacy_fd").alias("legacy_tickets"),
    )


def of_refunds(refunds: DataFrame) -> DataFrame:
    """One row on refunds."""
    reliable = F.col("order_link").isin("quoted", "fallback_unique")
    shared = F.col("n_in_group") > 1
    return refunds.agg(
        F.count_if(shared).alias("shared_tickets"),
        F.countDistinct(F.when(shared, F.col("order_id"))).alias("shared_orders"),
        money(F.col("excess")).alias("excess"),
        F.count_if(~F.coalesce(reliable, F.lit(False))).alias("unreliable_links"),
    )


def of_roster(agents: DataFrame, key: str, end: Column) -> DataFrame:
    """One row on assignments: how many, of how many agents, and of agents who have several."""
    each = agents.groupBy(key).agg(F.count("*").alias("n"), F.count_if(end.isNull()).alias("open"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"),
        F.count("*").alias("agents"),
        F.count_if(F.col("n") > 1).alias("several"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("several_rows"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("open_ended"),
    )


def of_keys(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row: orphans of each check, and surplus keys of each table that is referred to."""
    rows = quality.integrity(checks)  # a row for each check
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("check_name", "orphans"))))
    return rows.agg(F.sum("orphans").alias("orphans"), F.max("duplicate_keys").alias("_"), listed.alias("orphans_by_check")).drop("_")


def of_surplus(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """One row: keys beyond the first of their kind, by table."""
    counted = [df.agg((F.count(key) - F.countDistinct(key)).alias(name)) for name, df, key in tables]
    wide = side_by_side(counted)
    names = [name for name, _, _ in tables]
    return wide.select(F.struct(*names).alias("surplus_by_table"), sum((F.col(n) for n in names[1:]), F.col(names[0])).alias("surplus"))


def first_keys(df: DataFrame, key: str, n: int = _SAMPLE) -> DataFrame:
    """One row: the ``n`` smallest keys."""
    return df.select(key).orderBy(key).limit(n).agg(F.sort_array(F.collect_list(key)).alias("sample"))


def ledger(wide: DataFrame) -> DataFrame:
    """DQ-000 to DQ-012 from the wide row, by severity and id."""
    c = F.col
    quarter = lambda total: F.coalesce(ratio(total, c("months")) * 3, F.lit(0.0))
    step = lambda k, total, rows, before: F.struct(F.lit(k).alias("step"), F.round(total, 2).alias("value"), rows.alias("rows"), F.round(quarter(total), 2).alias("per_quarter"), F.round(total - before, 2).alias("delta"))
    raw, unit, single = c("raw_total"), c("unit_total"), c("single_total")
    steps = F.array(step(1, raw, c("raw_refunds"), raw), step(2, unit, c("raw_refunds"), raw), step(3, single, c("single_refunds"), unit))
    broken = c("orphans") + c("surplus")
    unit_proof = ("pairs", "distinct_ratios", "ratios", "divisor", "conclusive", "all_divisible", "legacy_median", "base_median", "converted_median", "agreement")
    findings = [
        Finding("DQ-000", "info", c("raw_refunds"), single, {"steps": steps, "months": c("months")}),
        Finding("DQ-001", "critical", c("legacy_refunds"), F.when(c("conclusive"), c("legacy_total")), {k: c(k) for k in unit_proof}),
        Finding("DQ-002", "high", c("redundant_rows"), F.abs(unit - single), {"duplicate_ids": c("duplicated_ids"), "redundant_rows": c("redundant_rows"), "sample": c("sample")}),
        Finding("DQ-003", F.when(c("shift.conclusive"), "high").otherwise("info"), F.when(c("shift.conclusive"), c("legacy_tickets")).otherwise(0), None, {"median_shift_hours": F.round(c("shift.shift"), 3), "expected_if_utc": F.lit(quality.UTC_SHIFT), "negative_rows": c("shift.negative_rows"), "adjusted": F.lit(False)}),
        Finding("DQ-004", "medium", c("without_order"), None, {"links": c("order_links")}),
        Finding("DQ-005", "info", c("several_rows"), None, {k: c(k) for k in ("assignments", "agents", "several", "open_ended")}),
        Finding("DQ-006", F.when(broken == 0, "info").otherwise("high"), broken, None, {"orphans": c("orphans_by_check"), "surplus": c("surplus_by_table"), "quoted_order_mismatch": c("mismatch")}),
        Finding("DQ-007", "high", c("shared_tickets"), c("excess"), {"orders": c("shared_orders"), "tickets": c("shared_tickets"), "excess": F.round(c("excess"), 2), "left_out_unreliable": c("unreliable_links")}),
        Finding("DQ-008", "medium", c("refund_on_open"), None, {"count": c("refund_on_open")}),
        Finding("DQ-009", "medium", c("before_order"), None, {"count": c("before_order")}),
        Finding("DQ-010", "info", c("without_score"), None, {"blank": c("without_score"), "total": c("tickets")}),
        Finding("DQ-011", "info", F.lit(0), None, {"missing": F.lit("delivered_at"), "available": F.lit("order_date")}),
        Finding("DQ-012", "info", c("sop_cited"), None, {"pattern": F.lit(SOP)}),
    ]
    return quality.ledger(unpivoted(wide, findings))
