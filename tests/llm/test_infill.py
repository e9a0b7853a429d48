import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import infill

EVENTS = infill.automaton()
TEXTS = st.text(st.one_of(st.sampled_from("abzAZ <>PSM\n.09éİ\U0001f600中"), st.characters(exclude_categories=["Cs"])), max_size=60)


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)


def brute(doc, text, seed=1, rate=90, spm=20):
    text = text or ""
    found = units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(found) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if not text or any(x in text for x in infill.SENTINELS) or h[2] % 100 >= rate:
        return len(found), "plain", text, None, None
    if h[3] % 100 < spm:
        return len(found), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(found), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_places_of_units(text):
    found, at = infill.Units(EVENTS, text), 0
    listed = units(text)
    assert found.n == len(listed) and found.marked == any(x in text for x in infill.SENTINELS)
    for k, unit in enumerate(listed):
        assert found.place(k) == at
        at += len(unit)
    assert found.place(found.n) == len(text)


def check(frame, **more):
    rows = infill.fill_in_middle(frame, **more).select("doc_id", "text", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back")).collect()
    for r in rows:
        told = {"seed": more.get("seed", 1), "rate": more.get("rate", 90), "spm": more.get("spm_rate", 20)}
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == brute(r["doc_id"], r["text"], **told)
        assert r["back"] == (r["text"] or "")
    return rows


def test_documents_round_trip(documents):
    rows = check(documents)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows_and_columns(spark, odd):
    odd = odd.withColumn("a.b", F.lit(1)).withColumn("at", F.lit("x")).withColumn("h1", F.lit("x")).withColumn("infill", F.lit("x"))
    rows = check(odd, seed=7, rate=100, spm_rate=50)
    assert len(rows) == odd.count()
    assert infill.fill_in_middle(odd).columns == odd.columns  # infill was the last
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    tricky = [(i, t) for i, t in enumerate(["<P", "<S><", "a<M>b", "<<", ">P<", "S>x<P y", "\r\n ", "<P>" * 3, "\U0001f600" * 5 + "ab" * 4])]
    check(spark.createDataFrame(tricky, "doc_id long, text string"), rate=100)


def test_other_sentinels(spark):
    names = ("[PRE]", "[SUF]", "[MID]")
    frame = spark.createDataFrame([(i, f"some text <P> number {i}.") for i in range(20)], "doc_id long, text string")
    out = infill.fill_in_middle(frame, rate=100, sentinels=names)
    back = out.select("text", infill.restored(F.col("infill.output"), F.col("infill.form"), names).alias("back"), "infill.form")
    assert back.where("text <> back or form = 'plain'").count() == 0


def test_one_scan_without_a_shuffle(documents):
    plan = infill.fill_in_middle(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
