import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import urls
from tallyforge.llm.shared import Scratch


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("HTTP://WWW.Example.ORG/es/1?q=1", "www.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1"),
        ("https://example.org/en/2#x", "example.org", "/en/2", "org/"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("https://a.com/fr/x", "a.com", "/fr/x", "com/fr/"),
        ("https://a.com/de/", "a.com", "/de/", "com/de/"),
        ("https://a.org", "a.org", "", None),
        ("https://a.org?x=/", "a.org", "", None),
        ("a.org/x", "", "", None),
        (None, "", "", None),
        ("x://y://z/", "y:", "//z/", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    row = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)


def test_mined_verdicts(spark):
    rows = [(i, f"https://s{i}.example.org/es/{i}") for i in range(30)] + [(100 + i, f"https://t{i}.com/fr/{i}") for i in range(30)] + [(200, "https://u.net/es/7"), (201, "https://u.net/fr/7"), (202, "https://u.net/xx/7"), (202, "https://u.net/xx/7")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in urls.judge(df).collect()}
    assert got[200] == ("block", "mined") and got[201] == ("allow", "mined") and got[202] == ("allow", "default") and got[0] == ("block", "rule")
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def brute_verdicts(rows, support=0.01, confidence=0.9, most=3, least=5):
    """Verdicts of urls that no rule decides, from all combinations of up to three tokens."""
    learnt = [(t, v) for t, v in rows if v and t]
    sets = {}
    for tokens, verdict in learnt:
        for k in range(1, most + 1):
            for c in itertools.combinations(sorted(tokens), k):
                sets.setdefault(c, Counter())[verdict] += 1
    rules = {}
    for c, seen in sets.items():
        whole = sum(seen.values())
        for verdict, n in seen.items():
            if n >= max(least, math.ceil(support * len(learnt))) and n / whole >= confidence:
                rules[c, verdict] = (n / whole, n / len(learnt), verdict)
    out = []
    for tokens, verdict in rows:
        met = [r for (c, _), r in rules.items() if verdict is None and set(c) <= set(tokens)]
        out.append(max(met)[2] if met else None)
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(list(t), v, 1) for t, v in rows], "tokens array<string>, verdict string, n long").groupBy("tokens", "verdict").agg(F.sum("n").alias("n"))
    found = urls.mined_verdicts(Scratch(spark, "test"), df, **options)
    return {} if found is None else {tuple(r["tokens"]): r["verdict"] for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        tokens = {t for t in "abcdefgh" if rng.random() < 0.3} | ({"x", "y", "z"} if rng.random() < 0.3 else set())
        bad = ("a" in tokens and "b" in tokens) or rng.random() < 0.05
        rows.append((tuple(sorted(tokens)), None if rng.random() < 0.3 else "block" if bad or "h" in tokens else "allow"))
    want = brute_verdicts(rows)
    got = mined(spark, rows)
    assert [got.get(t) if v is None else None for t, v in rows] == want and any(want)


def test_more_open_tokens_than_are_mined_whole(spark):
    """Twenty open tokens; the verdict is the parity of three of them, so that neither one nor two tell it, but all three do."""
    rng = random.Random(21)
    names = [f"q:{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for k in range(500):
        tokens = tuple(sorted(t for t in names if rng.random() < 0.45))
        odd = sum(t in tokens for t in ("q:a", "q:b", "q:c")) % 2
        rows.append((tokens, None if k % 4 == 0 else "block" if odd else "allow"))
    want = brute_verdicts(rows)
    got = mined(spark, rows)
    assert [got.get(t) if v is None else None for t, v in rows] == want and "block" in want


def test_one_url_makes_no_rule(spark):
    rows = [(("h:rare",), "block")] * 4 + [(("h:often",), "block")] * 5 + [((f"h:{i}",), "allow") for i in range(40)] + [(("h:rare",), None), (("h:often",), None)]
    assert mined(spark, rows) == {("h:often",): "block"}


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_many_keys_end_in_seconds(spark, noise):
    rng = random.Random(1)
    rows = [(tuple(sorted({f"q:k{i:02}" for i in range(30) if rng.random() >= noise} | {f"h:{k % 2}"})), "block" if k % 2 else "allow") for k in range(200)]
    rows.append((("h:1", "q:k03"), None))
    began = time.perf_counter()
    assert mined(spark, rows)[("h:1", "q:k03")] == "block"
    assert time.perf_counter() - began < 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "https://example.org/es/1", *"abcdef")] * 2, "page_id long, url string, _query string, _mined string, tokens string, found string, Verdict string, left string")
    out = urls.judge(df)
    assert out.columns == ["page_id", "url", "_query", "_mined", "tokens", "found", "left", "host", "path", "rule", "verdict", "by"]
    assert [(r["_query"], r["_mined"], r["tokens"], r["found"], r["left"], r["verdict"]) for r in out.collect()] == [("a", "b", "c", "d", "f", "block")] * 2
