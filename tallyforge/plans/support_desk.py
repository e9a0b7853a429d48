"""From raw files to clean tickets, refunds and the reports on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import decisions, evaluation, quality, reports, temporal
from tallyforge.operators.allocation import allocate_excess
from tallyforge.plans import findings as ledgers
from tallyforge.sources.files import blank_to_null, replace_table, to_date, to_number, to_stamp, to_whole
from tallyforge.sources.rules import contact_costs

BASE_SYSTEM, LEGACY_SYSTEM = "helpdesk", "legacy_fd"


@dataclass
class Desk:
    """The desk's tables; all are lazy but for the unit's one-row measurement."""

    raw: DataFrame
    tickets: DataFrame
    refunds: DataFrame
    unit: DataFrame
    divisor: int
    source: dict[str, DataFrame]


def typed_tickets(raw: DataFrame) -> DataFrame:
    """Strings to types; every row keeps the order in which it was read, as the last tie-break."""
    return raw.select(
        "ticket_id", "status", "channel", "customer_id", blank_to_null(F.col("order_id")).alias("order_id_source"), "product_sku", "category", "priority", "assigned_team", "agent_id", "customer_message", "agent_notes", "source_system",
        to_stamp(F.col("created_at")).alias("created_at"), to_stamp(F.col("first_response_at")).alias("first_response_at"), to_stamp(F.col("resolved_at")).alias("resolved_at"),
        to_whole(F.col("transfers"), 0).alias("transfers"), to_whole(F.col("csat_score")).alias("csat_score"), to_number(F.col("refund_amount_inr")).alias("amount"),
        blank_to_null(F.col("refund_reason_code")).alias("source_reason_code"), (F.upper(F.trim("replacement_issued")) == "Y").alias("replacement_issued"),
        F.monotonically_increasing_id().alias("ordinal"),
    )


def first_read(orders: DataFrame) -> DataFrame:
    """One row per order_id, the first in its file; a file is read by one task in its order (see ``read_csv``)."""
    numbered = orders.withColumn("_o", F.monotonically_increasing_id())
    return quality.dedupe_by_preference(numbered, ["order_id"], [F.col("_o")]).drop("_o", "duplicate_row_count")


def resolve_orders(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """``order_id`` and ``order_link``: the quoted order, else the customer's order of that product as of the ticket."""
    pair = lambda a, b: F.concat_ws("\x1f", a, b)
    known = orders.select(pair("customer_id", "sku").alias("pair"), to_date(F.col("order_date")).cast("timestamp_ntz").alias("ordered_at"), F.col("order_id").alias("found"))
    open_ = tickets.where("order_id_source is null").withColumn("pair", pair("customer_id", "product_sku"))
    linked = temporal.as_of_or_latest(open_, known, "pair", "created_at", "ordered_at", "found").drop("pair")
    names = {"unique": "fallback_unique", "as_of": "fallback_nearest", "latest": "fallback_nearest", "unresolved": "unresolved"}
    link = F.coalesce(*[F.when(F.col("link") == k, F.lit(v)) for k, v in names.items()])
    quoted = tickets.where("order_id_source is not null").withColumn("order_id", F.col("order_id_source")).withColumn("order_link", F.lit("quoted"))
    return quoted.unionByName(linked.withColumn("order_link", link).drop("link").withColumnRenamed("found", "order_id"))


def build(raw: dict[str, DataFrame], classifications: DataFrame | None = None, rules: dict | None = None) -> Desk:
    """The desk from its raw files; ``classifications`` as in ``decisions.classified``, where tickets have been classified.

    ``rules``: the policy's rules document (``sources.rules``), whose cost
    standards then count instead of those stated in ``decisions``.
    """
    typed = typed_tickets(raw["tickets"])
    unit = quality.detect_unit(typed, "ticket_id", "source_system", "amount", BASE_SYSTEM, LEGACY_SYSTEM)
    divisor = unit.first()["divisor"]
    converted = quality.convert_unit(typed, "amount", "source_system", LEGACY_SYSTEM, divisor)
    preferred = F.when(F.col("source_system") == BASE_SYSTEM, 0).otherwise(1)
    single = quality.dedupe_by_preference(converted, ["ticket_id"], [preferred, F.col("ordinal")], "source_system")
    linked = resolve_orders(single, raw["orders"])
    minutes = temporal.minutes_between(F.col("created_at"), F.col("first_response_at"))
    target, breached = temporal.sla(decisions.SLA_MINUTES, F.col("channel"), F.col("first_response_minutes"))
    value = raw["orders"].select("order_id", to_number(F.col("order_value_inr")).alias("order_value"), to_date(F.col("order_date")).alias("order_date"), "lot_code")
    roster = raw["agents"].select("agent_id", to_date(F.col("from_date")).cast("timestamp_ntz").alias("from_date"), to_date(F.col("to_date")).cast("timestamp_ntz").alias("to_date"), F.struct(F.col("team").alias("team"), to_whole(F.col("tier"), 1).alias("tier"), F.col("name").alias("agent_name")).alias("post"))
    tickets = (
        temporal.point_in_time(linked, roster, "agent_id", "created_at", "from_date", "to_date", "post")
        .join(first_read(value), "order_id", "left")
        .withColumn("month", temporal.month_key(F.col("created_at")))
        .withColumn("quarter", temporal.quarter_key(F.col("created_at")))
        .withColumn("first_response_minutes", minutes)
        .withColumn("handle_hours", temporal.minutes_between(F.col("first_response_at"), F.col("resolved_at")) / 60)
        .withColumn("sla_target_minutes", target)
        .withColumn("sla_breached", breached)
        .withColumn("days_since_order", temporal.days_since(F.col("order_date"), F.col("created_at")))
        .withColumn("is_refund", F.col("amount").isNotNull())
        .withColumn("is_attendance", F.col("status").isin("resolved", "closed"))
        .withColumn("was_duplicated", F.col("duplicate_row_count") > 1)
    )
    tickets = tickets.withColumn("data_quality_flags", quality.flags([
        ("UNIT_CONVERTED", F.col("unit_converted")),
        ("DUPLICATE_SOURCE_ROW", F.col("was_duplicated")),
        ("ORDER_LINK_INFERRED", F.col("order_link").startswith("fallback")),
        ("ORDER_UNRESOLVED", F.col("order_link") == "unresolved"),
        ("TICKET_BEFORE_ORDER", F.col("days_since_order") < 0),
        ("REFUND_EXCEEDS_ORDER", F.col("amount") > F.col("order_value") + decisions.TOLERANCE),
        ("REFUND_ON_OPEN_TICKET", F.col("is_refund") & ~F.col("is_attendance")),
        ("NEGATIVE_DURATION", (F.col("first_response_minutes") < 0) | (F.col("handle_hours") < 0)),
        ("CSAT_MISSING", F.col("csat_score").isNull()),
    ]))
    return Desk(typed, tickets, refunds_of(tickets, classifications, rules), unit, divisor, raw)


def saved(desk: Desk, folder: str) -> Desk:
    """The desk read back from ``folder``, where its tables are written once; reports then read these instead of joining anew.

    Refunds are written from the saved tickets' own plan, so they hold what
    ``build`` found. The tables are replaced if they are there.
    """
    spark = desk.tickets.sparkSession
    back = {}
    for name in ("raw", "tickets", "refunds", "unit"):
        replace_table(getattr(desk, name), f"{folder}/{name}")
        back[name] = spark.read.schema(getattr(desk, name).schema).parquet(f"{folder}/{name}")
    return Desk(back["raw"], back["tickets"], back["refunds"], back["unit"], desk.divisor, desk.source)


NO_CLASSIFICATIONS = "ticket_id string, created_at timestamp_ntz, reason_code string, dual_remedy boolean, refund_without_return boolean, confidence double, validation_status string, review_required boolean"


def refunds_of(tickets: DataFrame, classifications: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """Refunds with what exceeds their order's value, their classification, and their avoidability."""
    paid = tickets.where("is_refund")
    reliable = F.col("order_link").isin("quoted", "fallback_unique")
    group = F.when(reliable & F.col("order_id").isNotNull(), F.col("order_id")).otherwise(F.concat(F.lit("\x1f"), F.col("ticket_id")))
    shared = allocate_excess(paid.withColumn("_group", group), "_group", "amount", F.col("order_value"), ["created_at", "ticket_id"]).drop("_group")
    ratio = F.round(F.when(F.col("order_value") != 0, F.col("amount") / F.col("order_value")), 4)
    told = shared.withColumn("refund_to_order_ratio", ratio).withColumn("is_full_refund", F.coalesce(ratio >= 0.999, F.lit(False)))
    known = tickets.sparkSession.createDataFrame([], NO_CLASSIFICATIONS) if classifications is None else classifications
    judged = decisions.classified(told, known)
    cost = decisions.contact_cost(F.col("valid"), F.col("reason_code"), F.col("channel"), *contact_costs(rules))
    return judged.withColumn("contact_cost", cost)


def report_overview(desk: Desk) -> DataFrame:
    return reports.overview(desk.tickets, "month", "amount", F.col("is_refund"))


def report_monthly(desk: Desk) -> DataFrame:
    avoidable = desk.refunds.select("ticket_id", F.col("avoidability.value").alias("avoidable"))
    return reports.monthly(desk.tickets.join(avoidable, "ticket_id", "left"), "month", "amount", F.col("is_refund"), F.col("avoidable"), "csat_score")


def report_reasons(desk: Desk, basis: str = "source_dropdown") -> DataFrame:
    """By the code that agents picked (``source_dropdown``), or by the classified reason (``normalised``), which covers classified refunds only."""
    if basis == "source_dropdown":
        return reports.by_reason(desk.refunds, F.col("source_reason_code"), "amount")
    if basis != "normalised":
        raise ValueError(f"unknown basis {basis}")
    rows = desk.refunds.withColumn("_expected", decisions.expected_code(F.col("reason_code"))).withColumn("_avoidable", F.col("avoidability.value"))
    return reports.reasons(rows, F.col("reason_code"), "amount", F.col("source_reason_code"), F.col("_expected"), F.col("avoidability.label"), "_avoidable").orderBy(F.col("value").desc(), "reason")


def report_miscoding(desk: Desk) -> DataFrame:
    return reports.miscoding(desk.refunds, F.col("source_reason_code"), decisions.DROPDOWN_DEFAULT, F.col("reason_code"), decisions.expected_code(F.col("reason_code")), "amount")


def report_evaluation(desk: Desk, labels: DataFrame) -> dict[str, DataFrame]:
    """Classifications against ``labels`` (ticket_id, expected), which must be independent of them: accuracy, classes, confusions, error buckets, and labels not scored."""
    said = desk.refunds.where("classification is not null").select("ticket_id", F.col("reason_code").alias("predicted"))
    scored, without = evaluation.scoring_set(labels, desk.tickets, said, "ticket_id")
    counts = evaluation.confusion(scored, "expected", "predicted")
    wrong = scored.where("expected is not null and not (expected <=> predicted)")
    return {
        "accuracy": evaluation.scored(scored, "expected", "predicted"),
        "classes": evaluation.precision_recall(counts),
        "confusions": evaluation.top_confusions(counts),
        "errors": wrong.groupBy(decisions.error_bucket(F.col("expected"), F.col("predicted")).alias("bucket")).agg(F.count("*").alias("n")),
        "not_scored": without,
    }


def report_cost(desk: Desk, calls: DataFrame, fx: float, per_week: int) -> dict[str, DataFrame]:
    """Measured cost of model calls: the summary, and calls by model and by prompt."""
    n = desk.tickets.agg(F.count("*").alias("tickets"), F.count_if("is_refund").alias("refunds")).first()
    classified = desk.refunds.where("reason_code is not null").count()
    return {
        "summary": reports.cost_summary(calls, fx, classified, n["refunds"], n["tickets"], per_week),
        "models": evaluation.strata(calls, "model"),
        "prompts": evaluation.strata(calls, "prompt"),
    }


def findings(desk: Desk) -> DataFrame:
    """What the data shows, by severity: (finding_id, severity, affected_rows, affected_value, evidence).

    Reads each of the desk's tables once for all its findings; let ``saved``
    write the desk first, so that its joins run once too.
    """
    t, s = desk.tickets, desk.source
    named = lambda rows, **columns: rows.select(*[F.col(c).alias(n) for n, c in columns.items()])
    quoted = t.where("order_id_source is not null")
    stated = quality.dedupe_by_preference(named(s["orders"], order_id="order_id", _customer="customer_id", _sku="sku"), ["order_id"], [F.col("_customer"), F.col("_sku")])
    differs = quoted.join(stated, quoted["order_id_source"] == stated["order_id"], "left").agg(
        F.struct(F.count_if(~F.col("customer_id").eqNullSafe(F.col("_customer"))).alias("customer"), F.count_if(~F.col("product_sku").eqNullSafe(F.col("_sku"))).alias("product")).alias("mismatch")
    )
    checks = [
        ("ticket_customer", t, "customer_id", s["customers"], "customer_id"),
        ("ticket_order", quoted, "order_id_source", s["orders"], "order_id"),
        ("ticket_product", t, "product_sku", s["products"], "sku"),
        ("ticket_agent", t, "agent_id", s["agents"], "agent_id"),
        ("order_customer", s["orders"], "customer_id", s["customers"], "customer_id"),
        ("order_product", s["orders"], "sku", s["products"], "sku"),
    ]
    shift = quality.timestamp_shift(t, "source_system", "first_response_at", "resolved_at", LEGACY_SYSTEM)
    wide = ledgers.side_by_side([
        ledgers.of_raw(desk.raw, "source_system", "amount", LEGACY_SYSTEM, desk.divisor),
        ledgers.of_tickets(t),
        ledgers.of_refunds(desk.refunds),
        desk.unit.drop("severity"),
        quality.corroborate_unit(desk.raw, "ticket_id", "source_system", "amount", BASE_SYSTEM, LEGACY_SYSTEM, desk.divisor),
        shift.select(F.struct("*").alias("shift")),
        ledgers.of_roster(s["agents"], "agent_id", to_date(F.col("to_date"))),
        ledgers.of_keys(checks),
        ledgers.of_surplus([("orders", s["orders"], "order_id"), ("customers", s["customers"], "customer_id"), ("products", s["products"], "sku")]),
        ledgers.first_keys(t.where("was_duplicated"), "ticket_id"),
        differs,
    ])
    return ledgers.ledger(wide)


def report_agents(desk: Desk) -> DataFrame:
    posts = desk.tickets.groupBy("agent_id").agg(F.max_by("post", "created_at").alias("post"))
    peer = F.concat(F.lit("Tier "), F.col("post.tier"), F.lit(" · "), F.col("post.team"))
    return reports.against_peers(reports.by_agent(desk.tickets, "agent_id", "amount", F.col("is_refund"), posts, "agent_id", peer), "refunds_per_100")


def report_drivers(desk: Desk) -> DataFrame:
    return reports.by_driver(desk.refunds.select(F.col("avoidability.drivers").alias("drivers"), F.col("avoidability.value").alias("avoidable")), "drivers", "avoidable")


def report_lots(desk: Desk, least: int = 30) -> DataFrame:
    return reports.lot_scores(desk.tickets.where("lot_code is not null"), ["lot_code", "product_sku"], F.col("is_refund"), least).orderBy(F.col("z_score").desc(), "lot_code").limit(15)


def report_walk(desk: Desk, months: int) -> DataFrame:
    converted = quality.convert_unit(desk.raw, "amount", "source_system", LEGACY_SYSTEM, desk.divisor)
    return reports.walk([("raw export", desk.raw, "amount"), ("one unit", converted, "amount"), ("one row per ticket", desk.tickets, "amount")], months)


def evidence_rows(desk: Desk, months: tuple[str, str] | None = None, avoidable_only: bool = False, agent: str | None = None, reason: str | None = None, least: float | None = None) -> DataFrame:
    """Refund rows behind a report; the filters are pushed below everything else. Their count is the total that pages are of."""
    rows = desk.refunds
    for wanted, condition in (
        (months, F.col("month").between(*(months or ("", "")))),
        (avoidable_only, F.col("avoidability.value") > 0),
        (agent, F.col("agent_id") == agent),
        (reason, F.coalesce("reason_code", "source_reason_code") == reason),
        (least is not None, F.col("amount") >= (least or 0.0)),
    ):
        if wanted:
            rows = rows.where(condition)
    return rows


def evidence(desk: Desk, months: tuple[str, str] | None = None, avoidable_only: bool = False, agent: str | None = None, reason: str | None = None, least: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of ``evidence_rows``, largest first."""
    rows = evidence_rows(desk, months, avoidable_only, agent, reason, least)
    return rows.orderBy(F.col("amount").desc_nulls_last(), "ticket_id").offset(offset).limit(limit)
