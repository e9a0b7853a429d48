"""Fill-in-the-middle documents by a sparse scan for events.

A text's units are its runs of ASCII letters and its other code points, one by
one. One Aho-Corasick automaton reports where the class of a character changes
(every pair of a letter and another character is one of its words, in both
orders) and where a sentinel stands. Between two events all characters are of
one class, so the gap's units are known by arithmetic: one for letters, its
length for others. The code point at which a unit begins is then looked up by
bisection over the events' running counts; no unit is ever listed.

Only places leave the scan. Texts are cut and put together again by Spark's own
string functions, so no text comes back from Python.
"""

from __future__ import annotations

import string

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import fresh, table

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 1, 90, 20
_CHANGE, _SENTINEL = 0, 1
_PLACES = "n long, first long, second long, marked boolean"


def automaton(sentinels: tuple[str, str, str] = SENTINELS) -> ahocorasick.Automaton:
    """Words: every pair of ASCII characters of which one is a letter, and the sentinels."""
    found = ahocorasick.Automaton()
    others = [c for c in map(chr, range(128)) if c not in string.ascii_letters]
    for letter in string.ascii_letters:
        for other in others:
            found.add_word(letter + other, _CHANGE)
            found.add_word(other + letter, _CHANGE)
    for word in sentinels:
        found.add_word(word, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """Unit counts of a text from its events."""

    def __init__(self, events: ahocorasick.Automaton, text: str):
        # one ASCII character for each code point: none beyond ASCII is a letter
        plain = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        told = list(events.iter(plain))
        self.length = len(text)
        self.marked = any(kind == _SENTINEL for _, kind in told)
        changes = np.array([end for end, kind in told if kind == _CHANGE], dtype=np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), changes])
        sizes = np.diff(self.starts, append=self.length)
        first = bool(plain) and plain[0] in string.ascii_letters
        letters = (np.arange(len(sizes)) % 2 == 0) == first
        self.ends = np.cumsum(np.where(letters, np.minimum(sizes, 1), sizes))
        self.letters = letters
        self.n = int(self.ends[-1])

    def place(self, unit: int) -> int:
        """The code point at which ``unit`` begins, counted from 0; the text's end for ``n``."""
        if unit >= self.n:
            return self.length
        gap = int(np.searchsorted(self.ends, unit, side="right"))
        before = int(self.ends[gap - 1]) if gap else 0
        return int(self.starts[gap]) + (0 if self.letters[gap] else unit - before)


def places(sentinels: tuple[str, str, str] = SENTINELS):
    """Pandas UDF of (text, h1, h2): units, ends of prefix and middle in code points, and whether a sentinel stands in the text."""
    kept = []  # the automaton is made once a task, where it is used

    def scan(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(automaton(sentinels))
        out = []
        for text, a, b in zip(texts, one, two):
            units = Units(kept[0], text)
            low, high = sorted((a % (units.n + 1), b % (units.n + 1)))
            out.append((units.n, units.place(low), units.place(high), units.marked))
        return pd.DataFrame(out, columns=["n", "first", "second", "marked"])

    return F.pandas_udf(scan, _PLACES)


def _draw(doc: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the row's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with infill (form, output, n, prefix_chars, middle_chars), one row for each.

    Cuts fall between units, where the row's digest of ``seed`` and id says.
    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of those
    with the suffix first. Empty and null texts, and texts that contain a
    sentinel, stay plain: their output is the text (null: empty), their
    prefix_chars and middle_chars are null. A null id draws as an empty one. Rows
    are judged one by one, so repeated rows and ids have equal results. A column
    named infill is replaced, others of any name stay; an empty table gives an
    empty result. ``sentinels`` are distinct ASCII strings of three characters or
    more, and none starts as another ends (``restored`` relies on it).
    """
    quoted = lambda c: F.col(f"`{c}`")
    keep = [c for c in docs.columns if c.lower() != "infill"]
    text, at, *drawn = fresh(docs, "text", "at", "h1", "h2", "h3", "h4")
    h1, h2, h3, h4 = drawn
    told = docs.select(*map(quoted, keep), F.coalesce(quoted(text_col), F.lit("")).alias(text), *[_draw(quoted(id_col), seed, k).alias(h) for k, h in enumerate(drawn)])
    told = told.withColumn(at, places(sentinels)(F.col(text), F.col(h1), F.col(h2)))
    plain = (F.col(at)["n"] == 0) | F.col(at)["marked"] | (F.pmod(F.col(h3), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(F.col(h4), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    first, second = F.col(at)["first"].cast("int"), F.col(at)["second"].cast("int")
    prefix = F.substring(F.col(text), F.lit(1), first)
    middle = F.substring(F.col(text), first + 1, second - first)
    suffix = F.substring(F.col(text), second + 1, F.length(text))
    p, s, m = map(F.lit, sentinels)
    output = F.when(plain, F.col(text)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    size = lambda c: F.when(~plain, c.cast("long"))
    made = F.struct(form.alias("form"), output.alias("output"), F.col(at)["n"].alias("n"), size(first).alias("prefix_chars"), size(second - first).alias("middle_chars"))
    return told.select(*map(quoted, keep), made.alias("infill"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels))
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, one)).otherwise(F.concat(one, three, two))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_SQL_DRAW = "CAST('0x' || substr(digest, {}, 8) AS BIGINT)"
_SQL_OUTPUT = "CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
k AS (SELECT *, len(units) AS n, {_SQL_DRAW.format(1)} % (len(units) + 1) AS one, {_SQL_DRAW.format(9)} % (len(units) + 1) AS two,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_SQL_DRAW.format(17)} % 100 >= {RATE} THEN 'plain'
    WHEN {_SQL_DRAW.format(25)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(list_slice(units, 1, least(one, two)), '') AS prefix, array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), '') AS middle,
  array_to_string(list_slice(units, greatest(one, two) + 1, n), '') AS suffix FROM k),
o AS (SELECT *, {_SQL_OUTPUT} AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256 FROM o
"""

QUERIES = {"op13_infill": op13_infill}
ORACLES = {"op13_infill": SQL}
