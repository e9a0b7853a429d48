"""The desk's plan on a small pack of files, with amounts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import support_desk
from tallyforge.sources import files

TICKETS = [
    "T-1,2025-01-10 10:00,2025-01-10 10:05,2025-01-10 11:00,resolved,chat,C1,O1,S-EAR,Returns,High,Returns,A1,0,5,900,GW-OTHER,Y,case does not charge,issued refund + replacement both tl aware,helpdesk",
    "T-1,2025-01-10 10:00,2025-01-10 10:05,2025-01-10 11:00,resolved,chat,C1,O1,S-EAR,Returns,High,Returns,A1,0,5,90000,GW-OTHER,Y,case does not charge,issued refund + replacement both tl aware,legacy_fd",
    "T-2,2025-01-11 10:00,2025-01-11 10:40,2025-01-11 11:20,resolved,chat,C2,O2,S-HEAD,Login,Normal,Chat,A2,,4,,,N,cannot login,otp resent,helpdesk",
    "T-3,2025-02-01 09:00,2025-02-01 09:10,2025-02-01 09:40,resolved,email,C1,,S-EAR,Billing,Normal,Returns,A1,0,5,1999,DUP-PAYMENT,N,charged twice,checked pg for duplicate txn refunded,helpdesk",
    "T-4,2025-03-01 09:00,2025-03-01 09:12,2025-03-01 10:00,resolved,chat,C2,O2,S-HEAD,Returns,High,Returns,A1,0,,249900,CANCEL,N,change of mind please stop,cancelled before dispatch,legacy_fd",
]
PACK = {
    "tickets": TICKETS,
    "agents": ["A1,Asha Rao,North,Returns,Day,1,2021-11-13,", "A1,Asha Rao,North,Old desk,Day,2,2019-01-01,2021-11-12", "A2,NA,North,Chat,Night,1,2024-03-17,"],
    "orders": ["O1,C1,S-EAR,2024-12-01,web,1,1799,L-1", "O2,C2,S-HEAD,2024-12-15,web,1,4999,L-2", "O3,C1,S-EAR,2025-01-05,web,1,1799,L-3"],
    "customers": ["C1,One,X,XX,2024-01-01,N", "C2,Two,Y,YY,2024-02-01,Y"],
    "products": ["S-EAR,Ear,ear,2024-09-10,760,1799,12", "S-HEAD,Head,head,2023-10-01,2100,4999,12"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pack")
    for name, lines in PACK.items():
        (path / f"{name}.csv").write_text("\n".join([",".join(files.FILES[name]), *lines]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def desk(spark, folder):
    return support_desk.build(files.read_raw(spark, folder))


def test_missing_files_are_all_named(spark, folder, tmp_path):
    (tmp_path / "agents.csv").write_text("x\n")
    with pytest.raises(FileNotFoundError, match="tickets.csv, orders.csv, customers.csv, products.csv"):
        files.read_raw(spark, str(tmp_path))


def test_blank_and_na_stay_strings(spark, folder):
    raw = files.read_raw(spark, folder)
    assert raw["agents"].where("agent_id = 'A2'").first()["name"] == "NA"
    assert raw["tickets"].where("ticket_id = 'T-2'").first()["refund_amount_inr"] == ""


def test_unit_and_walk(desk):
    assert desk.divisor == 100
    steps = [r["value"] for r in support_desk.report_walk(desk, 3).orderBy("step").collect()]
    assert steps == [342799.0, 6298.0, 5398.0]


def test_single_tickets(desk):
    rows = {r["ticket_id"]: r for r in desk.tickets.collect()}
    assert len(rows) == 4
    assert rows["T-1"]["source_system"] == "helpdesk" and rows["T-1"]["was_duplicated"] and rows["T-1"]["amount"] == 900
    assert rows["T-3"]["amount"] == 1999 and rows["T-4"]["amount"] == 2499 and rows["T-4"]["unit_converted"]
    assert rows["T-2"]["transfers"] == 0 and rows["T-2"]["sla_breached"] is True and rows["T-4"]["sla_breached"] is False
    assert rows["T-3"]["order_id"] == "O3" and rows["T-3"]["order_link"] == "fallback_nearest"
    assert rows["T-1"]["post"]["team"] == "Returns"
    assert "REFUND_EXCEEDS_ORDER" in rows["T-3"]["data_quality_flags"]


def test_refunds_and_reports(desk):
    assert desk.refunds.count() == 3
    found = {r["ticket_id"]: r["avoidability"] for r in desk.refunds.collect()}
    assert found["T-1"]["label"] == "POTENTIALLY_AVOIDABLE" and found["T-1"]["value"] == 900
    assert found["T-4"]["label"] == "REVIEW_REQUIRED"
    one = support_desk.report_overview(desk).first()
    assert (one["tickets"], one["refunds"], one["refund_value"], one["months"]) == (4, 3, 5398.0, 3)
    months = {r["month"]: r for r in support_desk.report_monthly(desk).collect()}
    assert months["2025-03"]["score_mean"] is None and months["2025-01"]["avoidable_value"] == 900
    agents = {r["agent_id"]: r for r in support_desk.report_agents(desk).collect()}
    assert agents["A1"]["refunds_per_100"] == 100 and agents["A2"]["refunds_per_100"] == 0
    assert support_desk.report_drivers(desk).first()["gross_value"] == 900
    assert support_desk.report_lots(desk, 1).count() == 3
    assert [r["ticket_id"] for r in support_desk.evidence(desk, least=1000.0).collect()] == ["T-4", "T-3"]
    assert support_desk.report_reasons(desk).agg(F.sum("value")).first()[0] == 5398.0


def test_sinks(spark, desk, tmp_path):
    reasons = support_desk.report_reasons(desk)
    files.write_csv(reasons, str(tmp_path / "csv"), single=True)
    files.write_json(reasons, str(tmp_path / "json"))
    files.replace_table(reasons, str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert files.read_table(spark, str(tmp_path / "table"), ["reason"]).count() == 3
    assert "GW-OTHER" in files.markdown("Reasons", [("By reason", reasons)])
    assert "GW-OTHER" in files.board_json({"reasons": reasons})
    told = files.markdown("Reasons", [("By reason", reasons)], limit=2, money=("value",), shares=("share_pct",))
    assert "1 more rows are not shown" in told and "\u20b92,499" in told and "46.3%" in told
    with pytest.raises(ValueError, match="more than 2 rows"):
        files.board_json({"reasons": reasons}, limit=2)


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tickets": [{"id": "x", "label": "A"}, {"id": "y"}]}')
    (tmp_path / "b.json").write_text('[{"id": "x", "label": "A"}]')
    assert files.read_records(spark, str(tmp_path / "a.json"), "id string, label string", "tickets").count() == 2
    assert files.read_records(spark, str(tmp_path / "b.json"), "id string, label string").first()["label"] == "A"


def test_stream(spark, folder, tmp_path):
    from tallyforge.streaming import intake

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.csv").write_text(open(f"{folder}/tickets.csv").read())
    totals = intake.daily_totals(intake.ticket_stream(spark, str(source)))
    intake.write_stream(totals, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert closed.agg(F.sum("tickets")).first()[0] >= 3


def test_flat_variant(spark, folder):
    from tallyforge.operators import simple

    raw = files.read_raw(spark, folder)
    rows = simple.flatten(support_desk.typed_tickets(raw["tickets"]).withColumnRenamed("order_id_source", "order_id"), raw["orders"], raw["customers"], raw["products"], raw["agents"]).collect()
    found = {r["ticket_id"]: r for r in rows}
    assert len(found) == 4 and [found[f"T-{i}"]["clean_refund"] for i in (1, 2, 3, 4)] == [900, 0, 1999, 2499]
    assert found["T-1"]["agent_name"] == "Asha Rao" and found["T-1"]["customer_name"] == "One" and found["T-1"]["agent_team"] == "Returns"
    assert found["T-1"]["is_dual_remedy"] and found["T-1"]["avoidability"]["value"] == 900 and not found["T-2"]["is_refund"]
    assert found["T-4"]["handle_hours"] == pytest.approx(6.5) and found["T-1"]["product_family"] == "ear"


def test_classification_path(spark, folder):
    import datetime as dt

    day = lambda d: dt.datetime(2025, 4, d)
    rows = [
        ("T-1", day(1), "UNKNOWN", None, None, 0.9, "valid", False),
        ("T-1", day(2), "PRODUCT_FAULT_DOA", True, False, 0.9, "valid", False),
        ("T-3", day(1), "DUPLICATE_OR_FAILED_PAYMENT", False, False, 0.8, "repaired", False),
        ("T-4", day(1), "GOODWILL_GESTURE", False, False, 0.9, "valid", False),
    ]
    found = spark.createDataFrame(rows, support_desk.NO_CLASSIFICATIONS)
    desk = support_desk.build(files.read_raw(spark, folder), found)
    got = {r["ticket_id"]: r for r in desk.refunds.collect()}
    assert got["T-1"]["reason_code"] == "PRODUCT_FAULT_DOA" and got["T-1"]["avoidability"]["value"] == 900
    assert got["T-3"]["avoidability"]["label"] == "POLICY_COMPLIANT"
    assert got["T-4"]["avoidability"]["drivers"] == ["GOODWILL_OVER_CAP"] and got["T-4"]["avoidability"]["value"] == 1999
    reasons = {r["reason"]: r for r in support_desk.report_reasons(desk, "normalised").collect()}
    assert reasons["DUPLICATE_OR_FAILED_PAYMENT"]["agreement_pct"] == 100 and reasons["GOODWILL_GESTURE"]["agreement_pct"] == 0
    assert reasons["PRODUCT_FAULT_DOA"]["expected_code"] == "DOA-REPL" and sum(r["count_share_pct"] for r in reasons.values()) == pytest.approx(100)
    with pytest.raises(ValueError):
        support_desk.report_reasons(desk, "other")
    one = support_desk.report_miscoding(desk).first()
    assert (one["refunds"], one["on_default"], one["on_default_value"], one["comparable"], one["genuine_goodwill"]) == (3, 1, 900.0, 3, 0)
    labels = spark.createDataFrame([("T-1", "PRODUCT_FAULT_DOA"), ("T-4", "CUSTOMER_CHANGED_MIND"), ("T-2", "UNKNOWN"), ("T-9", "UNKNOWN"), ("T-3", None)], "ticket_id string, expected string")
    told = support_desk.report_evaluation(desk, labels)
    assert (told["accuracy"].first()["scored"], told["accuracy"].first()["correct"]) == (2, 1)
    assert [tuple(r) for r in told["errors"].collect()] == [("over_assigned_goodwill", 1)] and [r["ticket_id"] for r in told["not_scored"].collect()] == ["T-2"]
    assert support_desk.evidence_rows(desk, avoidable_only=True).count() == 2
    calls = spark.createDataFrame([(100, 20, 0.1, None, 5.0, "success", 0, False, "m", "v1"), (300, 20, 0.3, None, 7.0, "error", 2, True, "m", "v2")], "tokens_in long, tokens_out long, cost double, upstream double, latency_ms double, status string, retries int, cache_hit boolean, model string, prompt string")
    cost = support_desk.report_cost(desk, calls, 80.0, 600)
    row = cost["summary"].first()
    assert row["cost"] == pytest.approx(0.4) and row["cost_each"] == pytest.approx(0.4 * 80 / 3) and row["month_refunds"] == pytest.approx(0.4 * 80 / 3 * 2600 * 0.75)
    assert cost["prompts"].count() == 2 and support_desk.report_cost(desk, calls.limit(0), 80.0, 600)["summary"].first()["cost"] is None


def test_findings(spark, desk, tmp_path):
    import json

    kept = support_desk.saved(desk, str(tmp_path))
    rows = support_desk.findings(kept).collect()
    ledger = [(r["finding_id"], r["severity"], r["affected_rows"], r["affected_value"]) for r in rows]
    assert ledger == [
        ("DQ-001", "critical", 2, 3399.0), ("DQ-002", "high", 1, 900.0), ("DQ-007", "high", 0, 0.0), ("DQ-004", "medium", 1, None), ("DQ-008", "medium", 0, None), ("DQ-009", "medium", 0, None),
        ("DQ-000", "info", 4, 5398.0), ("DQ-003", "info", 0, None), ("DQ-005", "info", 2, None), ("DQ-006", "info", 0, None), ("DQ-010", "info", 1, None), ("DQ-011", "info", 0, None), ("DQ-012", "info", 0, None),
    ]
    proof = {r["finding_id"]: json.loads(r["evidence"]) for r in rows}
    assert [s["value"] for s in proof["DQ-000"]["steps"]] == [342799.0, 6298.0, 5398.0] and proof["DQ-000"]["steps"][2]["delta"] == -900.0
    assert proof["DQ-001"] == {"pairs": 1, "distinct_ratios": 1, "ratios": [100.0], "divisor": 100, "conclusive": True, "all_divisible": True, "legacy_median": 169950.0, "base_median": 1449.5, "converted_median": 1699.5, "agreement": 1.1725}
    assert proof["DQ-002"] == {"duplicate_ids": 1, "redundant_rows": 1, "sample": ["T-1"]}
    assert proof["DQ-004"]["links"] == {"quoted": 3, "fallback_unique": 0, "fallback_nearest": 1, "unresolved": 0}
    assert proof["DQ-005"] == {"assignments": 3, "agents": 2, "several": 1, "open_ended": 2}
    assert proof["DQ-006"]["quoted_order_mismatch"] == {"customer": 0, "product": 0} and set(proof["DQ-006"]["orphans"].values()) == {0}
    assert support_desk.report_overview(kept).first() == support_desk.report_overview(desk).first()


def test_contact_cost(spark):
    from tallyforge.operators import decisions

    c = [F.lit(True), F.lit("REFUND_SERVICE_FAILURE"), F.lit("chat")]
    row = spark.range(1).select(decisions.contact_cost(*c, {"chat": 30.0}, 60.0), decisions.contact_cost(*c[:2], F.lit("fax"), {"chat": 30.0}, 60.0), decisions.contact_cost(F.lit(False), *c[1:], {"chat": 30.0}, 60.0)).first()
    assert tuple(row) == (30.0, 60.0, 0.0)


def test_contact_costs_of_the_policy_end_to_end(spark, folder, tmp_path):
    import json

    from tallyforge.sources import rules

    raw = files.read_raw(spark, folder)
    said = spark.createDataFrame([("T-3", None, "REFUND_SERVICE_FAILURE", False, False, 0.9, "valid", False), ("T-4", None, "REFUND_SERVICE_FAILURE", False, False, 0.9, "valid", False)], support_desk.NO_CLASSIFICATIONS)
    costs = lambda **more: {r["ticket_id"]: r["contact_cost"] for r in support_desk.build(raw, said, **more).refunds.collect()}
    assert costs() == {"T-1": 0.0, "T-3": 260.0, "T-4": 210.0}
    assert rules.contact_costs(None) == ({"chat": 210.0, "email": 260.0, "voice": 520.0, "social": 240.0}, 290.0)
    stated = {"refunds": {}, "cost_standards": {"cost_per_contact_inr": {"chat": 211}, "blended_cost_per_contact_inr": 291}}
    (tmp_path / "r.json").write_text(json.dumps(stated))
    assert costs(rules=rules.read_rules(spark, str(tmp_path / "r.json"))) == {"T-1": 0.0, "T-3": 291.0, "T-4": 211.0}
    with pytest.raises(rules.RulesUnavailable):
        rules.contact_costs({"cost_standards": {"cost_per_contact_inr": 3}})


def test_rules_document(spark, tmp_path):
    import json

    from tallyforge.sources import rules

    good = {"version": "3.2", "refunds": {"cap": 500, "source_quote": "no more\nthan 500"}, "teams": [{"lead_quote": "Team Lead approves"}, {"name": "x"}]}
    (tmp_path / "r.json").write_text(json.dumps(good))
    found = rules.read_rules(spark, str(tmp_path / "r.json"), "3.2")
    document = spark.createDataFrame([("Goodwill: NO MORE  than 500 each.",)], "text string")
    told = {r["path"]: r["found"] for r in rules.verify_quotes(spark, found, document).collect()}
    assert told == {"$.refunds.source_quote": True, "$.teams[0].lead_quote": False}
    (tmp_path / "bad.json").write_text("[1]")
    for path in ("bad.json", "none.json"):
        with pytest.raises(rules.RulesUnavailable):
            rules.read_rules(spark, str(tmp_path / path))
    with pytest.warns(UserWarning, match="version 3.2"):
        assert rules.read_rules(spark, str(tmp_path / "r.json"), "4") == good
    assert rules.quotes(spark, {"refunds": {"quote": "no", "source_quote": 3, "deep": [[{"x_quote": "yes"}]]}}).collect() == [("$.refunds.deep[0][0].x_quote", "yes")]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("cast(id as int) as id", "id * 2.0 as v").coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "t").options(**options).save()
    whole = files.read_jdbc(spark, url, "select * from t", **options)
    assert whole.count() == 100
    dealt = files.read_jdbc(spark, url, "select * from t where \"id\" >= 50", ("id", 50, 100, 4), **options)
    assert dealt.rdd.getNumPartitions() == 4 and dealt.agg(F.sum("id")).first()[0] == sum(range(50, 100))
