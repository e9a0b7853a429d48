"""Rules over single rows: avoidability, authorisation, routing, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import patterns
from tallyforge.functions import text as T

# Fixed values of the policy: the rules' identifiers stand where they are tested, in ``authorise``.
GOODWILL_CAP = 500.0
CRITICAL_AMOUNT = 5000.0
AUTO_APPROVE_MAX = 500.0
TOLERANCE = 0.01
WARRANTY_TIER = 2
SLA_MINUTES = {"chat": 15, "voice": 120, "social": 240, "email": 480}
SLA_CREDIT = 350.0
CONTACT_COSTS, BLENDED_CONTACT_COST = {"chat": 210.0, "email": 260.0, "voice": 520.0, "social": 240.0}, 290.0
TRANSFER_COST, AGENT_HOUR_COST, SHIFT_HOURS = 305.0, 165.0, 8
REPEAT_DAYS = 30
DROPDOWN_DEFAULT = "GW-OTHER"
REASON_CODES = (
    "GOODWILL_GESTURE PRODUCT_FAULT_DOA PRODUCT_FAULT_IN_WARRANTY DAMAGED_IN_TRANSIT NOT_DELIVERED_OR_LOST "
    "WRONG_ITEM_SHIPPED RETURN_RECEIVED_QC_PASSED RETURN_PICKUP_FAILURE DUPLICATE_OR_FAILED_PAYMENT "
    "CANCELLED_BEFORE_DISPATCH CUSTOMER_CHANGED_MIND PRICE_OR_PROMO_ADJUSTMENT REFUND_SERVICE_FAILURE"
).split()
OUTCOMES = ("ALLOW", "REQUIRES_HUMAN_REVIEW", "DENY")
RISKS = ("low", "medium", "high", "critical")
# Assumed, as no source states it: the actions that move money or goods.
HIGH_RISK_ACTIONS = ("refund", "replacement", "goodwill_credit")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _hits(*rules: tuple[str, Column, Column]) -> Column:
    """array of (driver, value) of the rules that hold with a value above zero."""
    made = F.array(*[F.when(_true(when) & _true(value > 0), F.struct(F.lit(name).alias("driver"), value.cast("double").alias("value"))) for name, when, value in rules])
    return F.array_compact(made)


def _largest(hits: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hits, lambda h: h["value"])), F.lit(0.0))


def avoidability_simple(amount: Column, replaced: Column, source_code: Column, ai_avoidable: Column | None = None) -> Column:
    """struct(avoidable, value, drivers): dual remedy counts whole, goodwill above its cap; a model's finding counts only alone."""
    found = _hits(
        ("DUAL_REMEDY_PROHIBITED", replaced, amount),
        ("GOODWILL_CAP_EXCEEDED", (source_code == DROPDOWN_DEFAULT) & (amount > GOODWILL_CAP), amount - GOODWILL_CAP),
    )
    if ai_avoidable is not None:
        found = F.when(F.size(found) > 0, found).otherwise(_hits(("AI_POLICY_EXCEPTIONAL", ai_avoidable, amount)))
    return F.struct((F.size(found) > 0).alias("avoidable"), F.least(_largest(found), F.greatest(amount, F.lit(0.0))).alias("value"), F.transform(found, lambda h: h["driver"]).alias("drivers"))


def avoidability(amount: Column, flag: Column, ai_dual: Column, order_tickets: Column, order_excess: Column, valid: Column, reason: Column, ai_no_return: Column) -> Column:
    """struct(label, value, drivers, sections).

    The value is that of the largest driver, never the sum. Drivers that need no
    classification hold without one. Without any driver: REVIEW_REQUIRED where
    unclassified, AMBIGUOUS where the reason is, else POLICY_COMPLIANT.
    """
    valid = _true(valid)
    found = _hits(
        ("DUAL_REMEDY", _true(flag) | _true(ai_dual), amount),
        ("DUPLICATE_REFUND_SAME_ORDER", order_tickets >= 2, order_excess),
        ("GOODWILL_OVER_CAP", valid & (reason == "GOODWILL_GESTURE") & (amount > GOODWILL_CAP), amount - GOODWILL_CAP),
        ("REFUND_WITHOUT_RETURN", valid & (_true(ai_no_return) | _true(reason == "RETURN_PICKUP_FAILURE")), amount),
    )
    label = (
        F.when(F.size(found) > 0, "POTENTIALLY_AVOIDABLE")
        .when(~valid, "REVIEW_REQUIRED")
        .when(_true(reason.isin("AMBIGUOUS", "UNKNOWN")), "AMBIGUOUS")
        .otherwise("POLICY_COMPLIANT")
    )
    sections = F.when(label.isin("POTENTIALLY_AVOIDABLE", "POLICY_COMPLIANT"), F.array(F.lit("5"))).otherwise(F.array().cast("array<string>"))
    return F.struct(label.alias("label"), _largest(found).alias("value"), F.transform(found, lambda h: h["driver"]).alias("drivers"), sections.alias("sections"))


def channel_cost(channel: Column, costs: dict[str, float], blended: float) -> Column:
    return F.coalesce(*[F.when(channel == k, F.lit(v)) for k, v in costs.items()], F.lit(blended))


def contact_cost(valid: Column, reason: Column, channel: Column, costs: dict[str, float], blended: float) -> Column:
    return F.when(_true(valid) & _true(reason == "REFUND_SERVICE_FAILURE"), channel_cost(channel, costs, blended)).otherwise(0.0)


def classification_review(status: Column, reason: Column, confidence: Column, grounded: Column, injected: Column) -> Column:
    """The first reason for which a classification needs review, or null."""
    return (
        F.when(~_true(status.isin("valid", "repaired")), "invalid")
        .when(~_true(grounded), "ungrounded_evidence")
        .when(_true(reason.isin("UNKNOWN", "AMBIGUOUS")), "no_clear_reason")
        .when(_true(confidence < 0.5), "low_confidence")
        .when(_true(injected), "injection")
    )


def authorise(
    action: Column, amount: Column, reason: Column, replaced: Column, prior_count: Column, prior_value: Column, order_value: Column,
    agent_tier: Column, injected: Column, approved_by: Column, valid_codes: tuple[str, ...] = (), router_human: Column | None = None,
    router_risk: Column | None = None, router_degraded: Column | None = None, policy_available: Column | None = None,
) -> Column:
    """struct(decision, rules, risk, approver, fail_closed, approver_verified) of a requested action.

    The worst outcome of all checks wins. A recorded approval lifts a review to
    ALLOW but never a denial; whether the approver holds the role needed is not
    checked anywhere, so ``approver_verified`` is always false. The risk has a
    floor by amount, which a router may raise, not lower. Without a policy all is
    withheld for review.
    """
    false = F.lit(False)
    human, degraded = _true(router_human if router_human is not None else false), _true(router_degraded if router_degraded is not None else false)
    available = F.coalesce(policy_available if policy_available is not None else F.lit(True), F.lit(True))
    code = F.upper(F.coalesce(reason, F.lit("")))
    prior = F.coalesce(prior_count, F.lit(0))
    refund, replacement, credit = action == "refund", action == "replacement", action == "goodwill_credit"
    high_risk = action.isin(*HIGH_RISK_ACTIONS)
    goodwill = credit | code.isin("GOODWILL_GESTURE", DROPDOWN_DEFAULT)
    exceeds_with_prior = _true(F.coalesce(prior_value, F.lit(0.0)) + amount > order_value + TOLERANCE)
    warranty = replacement & code.isin("PRODUCT_FAULT_IN_WARRANTY", "WARRANTY")
    known = [*REASON_CODES, *valid_codes]
    allow, review, deny = 0, 1, 2
    checks = [
        ("SEC-001-prompt-injection", review, _true(injected)),
        ("POL-5-001-dual-remedy-prohibited", deny, (refund & _true(replaced)) | (replacement & (prior > 0))),
        ("POL-5-004-no-second-refund-same-order", deny, refund & (prior > 0) & exceeds_with_prior),
        ("POL-5-004-no-second-refund-same-order", review, refund & (prior > 0) & ~exceeds_with_prior),
        ("POL-5-002-goodwill-cap-500", deny, goodwill & _true(amount > GOODWILL_CAP)),
        ("POL-5-002-goodwill-cap-500", review, goodwill & ~_true(amount > GOODWILL_CAP)),
        ("POL-6-001-warranty-replacement-tier2", review, warranty & agent_tier.isNull()),
        ("POL-6-001-warranty-replacement-tier2", deny, warranty & _true(agent_tier < WARRANTY_TIER)),
        ("POL-5-003-reason-code-in-taxonomy", review, refund & (code == "")),
        ("POL-5-003-reason-code-in-taxonomy", deny, refund & (code != "") & ~code.isin(*known)),
        ("CTL-001-amount-required", review, (refund | credit) & amount.isNull()),
        ("CTL-003-critical-amount-manager", review, high_risk & _true(amount >= CRITICAL_AMOUNT)),
        ("CTL-002-auto-approve-ceiling", review, high_risk & _true((amount > AUTO_APPROVE_MAX) & (amount < CRITICAL_AMOUNT))),
        ("CTL-004-refund-exceeds-order-value", deny, refund & _true(amount > order_value + TOLERANCE)),
        ("ROUTER-requires-human", review, human),
        ("ROUTER-unavailable", review, degraded & high_risk),
    ]
    made = F.array_compact(F.array(*[F.when(_true(when), F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"))) for rule, rank, when in checks]))
    found = F.when(available, made).otherwise(F.array(F.struct(F.lit(review).alias("rank"), F.lit("SYS-001-policy-available").alias("rule"))))
    worst = F.coalesce(F.array_max(F.transform(found, lambda c: c["rank"])), F.lit(allow))
    held = worst == review
    lifted = held & available & _true(F.length(approved_by) > 0)
    rank = F.when(lifted, allow).otherwise(worst)
    has = lambda rule: F.exists(found, lambda c: c["rule"] == rule)
    approver = F.when(held, F.when(~available, "Team Lead").when(has("CTL-003-critical-amount-manager"), "Manager").otherwise("Team Lead"))
    floor = F.when(~high_risk, 0).when(amount.isNull(), 2).when(amount >= CRITICAL_AMOUNT, 3).when(amount > AUTO_APPROVE_MAX, 2).otherwise(1)
    raised = F.coalesce(*[F.when(router_risk == r, F.lit(i)) for i, r in enumerate(RISKS)], F.lit(0)) if router_risk is not None else F.lit(0)
    risk = F.when(available, F.greatest(floor, raised)).otherwise(3)
    closed = ~available | _true((refund | credit) & amount.isNull()) | (degraded & high_risk)
    return F.struct(
        F.element_at(F.array(*map(F.lit, OUTCOMES)), rank + 1).alias("decision"),
        F.transform(found, lambda c: c["rule"]).alias("rules"),
        F.element_at(F.array(*map(F.lit, RISKS)), risk + 1).alias("risk"),
        approver.alias("approver"),
        closed.alias("fail_closed"),
        F.lit(False).alias("approver_verified"),
    )


def prior_refunds(requests: DataFrame, refunds: DataFrame, order: str, ticket: str, amount: str, replaced: str) -> DataFrame:
    """``requests`` with count, sum and any replacement of the order's refunds on other tickets.

    Totals by order less what the request's own ticket holds: two joins on
    aggregates, no pairs of refunds.
    """
    whole = refunds.groupBy(order).agg(F.count("*").alias("_n"), F.sum(amount).alias("_v"), F.count_if(F.col(replaced)).alias("_r"))
    own = refunds.groupBy(order, ticket).agg(F.count("*").alias("_on"), F.sum(amount).alias("_ov"), F.count_if(F.col(replaced)).alias("_or"))
    zero = F.lit(0)
    return (
        requests.join(whole, order, "left")
        .join(own, [order, ticket], "left")
        .withColumn("prior_count", F.coalesce("_n", zero) - F.coalesce("_on", zero))
        .withColumn("prior_value", F.when(F.col("prior_count") > 0, F.coalesce("_v", F.lit(0.0)) - F.coalesce("_ov", F.lit(0.0))).otherwise(0.0))
        .withColumn("prior_replaced", F.coalesce("_r", zero) > F.coalesce("_or", zero))
        .drop("_n", "_v", "_r", "_on", "_ov", "_or")
    )


def route_simple(amount: Column, replaced: Column, code: Column, message: Column) -> Column:
    """struct(intent, complexity, needs_llm, needs_policy, needs_human, destination) of a ticket."""
    said = F.lower(F.coalesce(message, F.lit("")))
    refund = F.coalesce(amount, F.lit(0.0)) > 0
    dual, capped = refund & _true(replaced), refund & _true((code == DROPDOWN_DEFAULT) & (amount > GOODWILL_CAP))
    shipping = refund & (F.contains(said, F.lit("delay")) | F.contains(said, F.lit("cancel")))
    intent = (
        F.when(~refund, "NON_REFUND_GENERAL_QUERY").when(dual, "DUAL_REMEDY_PROHIBITED_CHECK").when(capped, "GOODWILL_CAP_EXCEEDED_CHECK")
        .when(shipping, "SHIPPING_OR_CANCELLATION").otherwise("GENERAL_REFUND_CLASSIFICATION")
    )
    complexity = F.when(~refund, "LOW").when(dual, "HIGH").when(capped, "MEDIUM").when(shipping, "LOW").otherwise("MEDIUM")
    return F.struct(
        intent.alias("intent"), complexity.alias("complexity"), (refund & ~dual).alias("needs_llm"), refund.alias("needs_policy"), dual.alias("needs_human"),
        F.when(refund, "FINANCE_RECONCILIATION").otherwise("SUPPORT_QUEUE").alias("destination"),
    )


def fallback_route(message: Column, injected: Column, identifiers: tuple[str, ...] = patterns.IDENTIFIERS) -> Column:
    """struct(intent, personal, risk, needs_llm, needs_policy, needs_human, cacheable), the safe decision while no router answers.

    ``identifiers``: patterns of how the desk names orders, tickets and customers.
    """
    intent = T.intent(message)
    personal = T.matches(message, patterns.personal(identifiers))
    money = intent.isin(*patterns.MONEY_INTENTS)
    generic = intent.isin("policy_question", "product_info") & ~personal
    flagged = _true(injected)
    return F.struct(
        intent.alias("intent"), personal.alias("personal"),
        F.when(flagged | money, "high").when(personal, "medium").otherwise("low").alias("risk"),
        (~generic).alias("needs_llm"), (money | intent.isin("warranty", "policy_question", "refund_status")).alias("needs_policy"),
        (money | flagged).alias("needs_human"), (generic & ~flagged).alias("cacheable"),
    )


def inbound_route(message: Column, cached: Column) -> Column:
    """blocked, cache, deterministic, human, policy or llm: where a message goes, the first that applies."""
    flagged = F.size(T.injections(message)) > 0
    fallback = fallback_route(message, flagged)
    return (
        F.when(flagged, "blocked").when(_true(cached), "cache").when(T.faq(message).isNotNull(), "deterministic")
        .when(fallback["needs_human"], "human").when(fallback["needs_policy"], "policy").otherwise("llm")
    )


def error_bucket(expected: Column, predicted: Column) -> Column:
    """The kind of a wrong label; pairs count either way round."""

    def pair(a: str, b: str) -> Column:
        return expected.isin(a, b) & predicted.isin(a, b)

    return (
        F.when(predicted == "UNKNOWN", "abstained_unknown")
        .when(predicted == "AMBIGUOUS", "abstained_ambiguous")
        .when(pair("REFUND_SERVICE_FAILURE", "RETURN_RECEIVED_QC_PASSED"), "refund_delay_vs_qc_return")
        .when(pair("PRODUCT_FAULT_DOA", "PRODUCT_FAULT_IN_WARRANTY"), "doa_vs_in_warranty")
        .when(pair("DAMAGED_IN_TRANSIT", "NOT_DELIVERED_OR_LOST"), "damaged_vs_lost_in_transit")
        .when(pair("CANCELLED_BEFORE_DISPATCH", "CUSTOMER_CHANGED_MIND"), "cancellation_vs_change_of_mind")
        .when(predicted == "GOODWILL_GESTURE", "over_assigned_goodwill")
        .when(expected == "GOODWILL_GESTURE", "under_assigned_goodwill")
        .otherwise("other_confusion")
    )


# The reasons that the dropdown's codes stand for; its default stands for none.
DROPDOWN_REASONS = {
    "DOA-REPL": "PRODUCT_FAULT_DOA", "LOST-TRANSIT": "NOT_DELIVERED_OR_LOST", "DUP-PAYMENT": "DUPLICATE_OR_FAILED_PAYMENT", "CANCEL": "CANCELLED_BEFORE_DISPATCH",
    "PRICE-ADJ": "PRICE_OR_PROMO_ADJUSTMENT", "RETURN-QC-OK": "RETURN_RECEIVED_QC_PASSED", "WTY-BUYBACK": "PRODUCT_FAULT_IN_WARRANTY",
}
# Assumed, as no source states it: the code that a reason should have been given.
EXPECTED_CODES = {reason: code for code, reason in DROPDOWN_REASONS.items()} | {"GOODWILL_GESTURE": DROPDOWN_DEFAULT}


def expected_code(reason: Column) -> Column:
    """The dropdown's code for a normalised reason, null where it has none."""
    return F.coalesce(*[F.when(reason == r, F.lit(c)) for r, c in EXPECTED_CODES.items()])


def rubric_label(code: Column, message: Column, notes: Column, flag: Column) -> Column:
    """struct(reason, avoidability): a rule-made label, not ground truth. A note that reads clearly beats the dropdown."""
    said = F.lower(F.coalesce(notes, F.lit("")))

    def says(phrases: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(said, F.lit(p))
        return hit

    note = T.refund_reason(message, notes)
    dropdown = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in DROPDOWN_REASONS.items()])
    read = F.when(dropdown.isNotNull() & note.isin("UNKNOWN", "AMBIGUOUS"), dropdown).otherwise(note)
    dual, denied, no_return = says(patterns.RUBRIC_DUAL), says(patterns.RUBRIC_NOT_DUAL), says(patterns.RUBRIC_NO_RETURN)
    remedy = _true(flag) | dual
    avoid = (
        F.when(_true(flag) & denied & ~dual, "AMBIGUOUS").when(remedy | no_return, "POTENTIALLY_AVOIDABLE")
        .when(read.isin("UNKNOWN", "AMBIGUOUS"), "AMBIGUOUS").otherwise("POLICY_COMPLIANT")
    )
    reason = F.when(~remedy & no_return & (read == "UNKNOWN"), "RETURN_PICKUP_FAILURE").otherwise(read)
    return F.struct(reason.alias("reason"), avoid.alias("avoidability"))


def idempotency(requests: DataFrame, key: str, payload_hash: str, order: str) -> DataFrame:
    """``outcome`` of each request: first of its key claims it, the same payload later replays, another conflicts."""
    first = requests.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(payload_hash).alias("h"))).alias("_first"))
    same = F.col(payload_hash).eqNullSafe(F.col("_first.h"))
    return requests.join(first, key).withColumn("outcome", F.when(F.col(order) == F.col("_first.o"), "claimed").when(same, "replayed").otherwise("conflict")).drop("_first")


def classified(refunds: DataFrame, classifications: DataFrame) -> DataFrame:
    """``refunds`` with their ticket's classification and the avoidability that follows from both.

    ``refunds``: ticket_id, amount, replacement_issued, n_in_group, excess, channel.
    ``classifications``: ticket_id, reason_code, dual_remedy, refund_without_return,
    confidence, validation_status, review_required; of several for one ticket the
    largest ``created_at`` counts, then the one that sorts last. Adds ``classification`` (null
    where there is none), ``reason_code``, ``valid``, ``avoidability``. A refund
    without a valid classification is judged by the rules that need none.
    """
    rest = [c for c in classifications.columns if c not in ("ticket_id", "created_at")]
    newest = classifications.groupBy("ticket_id").agg(F.max(F.struct("created_at", *rest)).alias("classification"))
    rows = refunds.join(newest, "ticket_id", "left")
    c = lambda name: F.col("classification")[name]
    valid = _true(c("validation_status").isin("valid", "repaired")) & ~F.coalesce(c("review_required"), F.lit(False))
    rows = rows.withColumn("valid", F.col("classification").isNotNull() & valid)
    found = avoidability(F.col("amount"), F.col("replacement_issued"), c("dual_remedy"), F.col("n_in_group"), F.col("excess"), F.col("valid"), c("reason_code"), c("refund_without_return"))
    return rows.withColumn("reason_code", c("reason_code")).withColumn("avoidability", found)


def action_context(requests: DataFrame, orders: DataFrame, refunds: DataFrame, agents: DataFrame) -> DataFrame:
    """``requests`` (order_id, ticket_id, requested_by) with tier and team of who asks, the order's value, and its refunds on other tickets.

    An agent with several posts counts with the one that started last, and of
    equal ones the one that sorts last; an order that is told twice with its
    largest value. Unknown agents and orders leave nulls.
    """
    posts = agents.groupBy(F.col("agent_id").alias("requested_by")).agg(F.max(F.struct("from_date", "tier", "team")).alias("_post"))
    values = orders.groupBy("order_id").agg(F.max("order_value").alias("order_value"))
    rows = requests.join(posts, "requested_by", "left").join(values, "order_id", "left")
    rows = rows.withColumn("agent_tier", F.col("_post.tier")).withColumn("agent_team", F.col("_post.team")).drop("_post")
    return prior_refunds(rows, refunds, "order_id", "ticket_id", "amount", "replacement_issued")
