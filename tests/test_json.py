import json
import re

from pyspark.sql import functions as F

from tallyforge.functions import text as T

SAID = [
    None, "", "  \n", "nothing here", '{"b": 1, "a": [1, 2.5, "x"]}', ' {"a": 1} ', '[{"a": 1}]', '"{}"', "3", "null", "true {}", '{"a": 1} and {"b": 2}', 'see {"a": {"b": "}{"}} end', 'see {"a": "quo\\"te }"} end',
    "{ oops {\"a\": 1}", "{oops} {\"a\": 1}", '{"a": "not closed }', "```json\n{\"a\": 1}\n``` {\"b\": 2}", "```\n[1]\n```", "``` {\"a\": 1}", "<think>{\"no\": 1}</think>{\"a\": 2}", "<THINK>x\ny</THINK> so {\"a\": {}}", '{"a": "x" }, "rest"', "1, {\"a\": 1}", '{"a": "\\u00e9 \U0001f600 }"} {',
    'a "quote {" then {"a": 1}', "}{", "}", "{", "{}", '{"a": 1, }', "{'a': 1}", '{"z": {"y": [ {"x": null} ]}}', "text " + '{"k": "' + "long " * 3000 + '\\" }"} tail }', "{" * 50 + "}" * 50,
]


def plain(text, widest=False):
    """By the standard library."""
    text = re.sub(r"(?is)<think>.*?</think>", "", text or "").strip()
    block = re.search(r"(?is)```(?:json)?\s*(.*?)```", text)
    text = block[1].strip() if block else text
    if not text:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        if "{" not in text:
            return None
        begin = text.index("{")
        if widest:
            piece = text[begin : text.rfind("}") + 1]
        else:
            depth, inside, at = 0, False, begin
            while at < len(text):
                c = text[at]
                if inside:
                    at += c == "\\"
                    inside = c != '"'
                else:
                    inside = c == '"'
                    depth += (c == "{") - (c == "}")
                    if c == "}" and not depth:
                        break
                at += 1
            piece = text[begin : at + 1]
        try:
            found = json.loads(piece)
        except ValueError:
            return None
    return found if isinstance(found, dict) else None


def test_answers(spark):
    frame = spark.createDataFrame(list(enumerate(SAID)), "id int, said string")
    for row in frame.select("id", "said", T.answer_json(F.col("said")).alias("a"), T.answer_json(F.col("said"), widest=True).alias("w")).collect():
        for got, widest in ((row["a"], False), (row["w"], True)):
            want = plain(row["said"], widest)
            assert (None if got is None else json.loads(got)) == want, (row["said"], widest)
    plan = frame.select(T.answer_json(F.col("said")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_quotes_by_letters_and_digits(spark):
    source = "Goodwill: no more than ₹500 — “each”, per order; it is a  gesture\nnot a right and never an entitlement of any kind at all. Refunds go to the payer."
    quotes = {"no more than 500 each": True, "NO MORE THAN - 500 'each' per order": True, "no more than 600": False, "!!": False, "": False, None: False}
    frame = spark.createDataFrame([(source, q) for q in quotes], "source string, quote string")
    assert {r["quote"]: r["found"] for r in frame.select("quote", T.quote_found(F.col("source"), F.col("quote")).alias("found")).collect()} == quotes
