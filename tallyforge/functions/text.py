"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import patterns

_ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def first_rule(rules, *texts: Column, default: str) -> Column:
    """The name of the first rule that matches, all rules on the first text, then all on the next."""
    return F.coalesce(*[F.when(matches(t, p), F.lit(n)) for t in texts for n, p in rules], F.lit(default))


def refund_reason(message: Column, notes: Column) -> Column:
    return first_rule(patterns.REASONS, notes, message, default="UNKNOWN")


def dual_remedy(notes: Column) -> Column:
    return ~matches(notes, patterns.NO_DUAL_REMEDY) & matches(notes, patterns.DUAL_REMEDY)


def intent(message: Column) -> Column:
    return first_rule(patterns.INTENTS, message, default="other")


def injections(text: Column) -> Column:
    """Names of the injection patterns in a text that has been normalised."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(n)) for n, p in patterns.INJECTIONS]))


def _nfkc(text: Column) -> Column:
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(compose, "string")(text)


def normalise(text: Column) -> Column:
    """NFKC, without zero-width and control characters other than newline and tab. Only texts beyond ASCII are sent to Python."""
    plain = text.rlike(r"^\p{ASCII}*$")
    composed = F.coalesce(F.when(plain, text), _nfkc(F.when(~plain, text)))
    return F.regexp_replace(F.translate(F.coalesce(composed, F.lit("")), _ZERO_WIDTH, ""), r"[\p{C}&&[^\n\t]]", "")


def sanitise(text: Column, most: int = 4000) -> Column:
    clean = F.regexp_replace(normalise(text), f"(?i){patterns.FENCE}", "[removed-delimiter]")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("\n[truncated]"))).otherwise(clean)


def wrap_untrusted(text: Column, label: str, most: int = 4000) -> Column:
    tag = "".join(c for c in label.upper().replace(" ", "_") if c.isascii() and (c.isalpha() or c == "_")) or "DATA"
    return F.concat(F.lit(f"<<<UNTRUSTED_{tag}_BEGIN>>>\n"), sanitise(text, most), F.lit(f"\n<<<UNTRUSTED_{tag}_END>>>"))


def mask_name(name: Column) -> Column:
    """First name and the last one's initial; (unknown) for none."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    n = F.size(words)
    return F.when(name.isNull() | (n < 1), "(unknown)").when(n == 1, words[0]).otherwise(F.concat(words[0], F.lit(" "), F.substring(F.element_at(words, -1), 1, 1), F.lit(".")))


def pseudonym(value: Column, salt: str) -> Column:
    return F.concat(F.lit("px_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, 12))


def stable_hash(*parts: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the parts, each ended by 0x1f."""
    return F.substring(F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\x1f")) for p in parts]), 256), 1, 32)


def normalise_query(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"[\s?!.]+$", "")


def token_estimate(characters: Column, messages: Column) -> Column:
    return (F.floor(characters / 3.6) + 8 * messages).cast("long")


MISSING = "\u2014"


def _marked(value: Column, places: int) -> Column:
    """``format_number`` with every digit: of a double above 2**53 it would print only those that tell it from its neighbours."""
    size, binary = F.abs(value), F.typeof(value).isin("double", "float")
    return F.when(binary & (size >= 2.0**53) & (size < 2.0**63), F.format_number(value.try_cast("long"), places)).otherwise(F.format_number(value, places))


def rupees(value: Column) -> Column:
    """Whole rupees with thousands marked, halves to even; zero has no sign, though a debt that rounds to it has; a dash for null."""
    return F.coalesce(F.concat(F.lit("\u20b9"), F.when(value == 0, "0").otherwise(_marked(value, 0))), F.lit(MISSING))


def percent(value: Column) -> Column:
    """One decimal place, halves to even; a dash for null."""
    return F.coalesce(F.concat(F.replace(_marked(value, 1), F.lit(",")), F.lit("%")), F.lit(MISSING))


def within_budget(tokens: Column, used: Column, budget: int) -> Column:
    """Whether a call of so many tokens still fits a run's budget; a budget of 0 is none."""
    return F.lit(budget == 0) | (used + tokens <= budget)


def evidence_json(source: Column, spans: Column) -> Column:
    """Nested evidence as JSON: of ``spans`` (array of structs with ``quote`` and any others) those whose quote the source has word for word."""
    return F.to_json(F.filter(spans, lambda s: (F.length(s["quote"]) > 0) & F.contains(source, s["quote"])))


def grounded(source: Column, quotes: Column) -> Column:
    """The quotes that the source has word for word."""
    return F.filter(quotes, lambda q: (F.length(q) > 0) & F.contains(source, q))


def _first_closed(text: Column) -> Column:
    """From the first brace to the one that closes it, whatever braces stand in strings; null where none does.

    The text is cut into strings, braces and what lies between, after escaped
    characters are blanked, and depth and length are folded over these pieces.
    """
    rest = F.regexp_extract(text, r"(?s)\{.*\z", 0)
    pieces = F.regexp_extract_all(F.regexp_replace(rest, r"(?s)\\.", "  "), F.lit(r'(?s)"[^"]*+(?:"|\z)|[{}]|[^"{}]++'), F.lit(0))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        length = at["length"] + F.length(piece)
        moved = F.struct(depth.alias("depth"), length.alias("length"), ((piece == "}") & (depth == 0)).alias("closed"))
        return F.when(at["closed"], at).otherwise(moved)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))
    return F.aggregate(pieces, start, step, lambda at: F.when(at["closed"], F.substring(rest, F.lit(1), at["length"])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _object_or(text: Column, other: Column) -> Column:
    """A text that is one JSON object, as compact JSON with sorted keys; null if it is other JSON, ``other`` if it is none."""
    alone = lambda found: F.get(found, F.lit(0))
    own = lambda found: F.when(F.schema_of_variant(alone(found)).startswith("OBJECT"), F.to_json(alone(found)))
    may = text.rlike(r'^\s*([\[{"0-9-]|(true|false|null)\s*\z)')  # trying to parse prose is dear
    whole = F.when(may, F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>"))
    return _let(whole, lambda found: F.when(F.size(found) == 1, own(found)).otherwise(other))


def answer_json(text: Column, widest: bool = False) -> Column:
    """The object of a model's JSON answer, as compact JSON with sorted keys, or null.

    Reasoning tags go, of fenced blocks the first counts. An answer that is JSON
    as a whole must be an object. Otherwise the object is what the first brace
    opens, up to the brace that closes it; if that is not well-formed there is
    none, whatever follows. ``widest``, the simpler variant: up to the last brace.
    """
    none = F.lit(None).cast("string")
    block = r"(?is)```(?:json)?\s*(.*?)```"
    trimmed = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")

    def within(inner: Column) -> Column:
        part = F.nullif(F.regexp_extract(inner, r"(?s)\{.*\}", 0), F.lit("")) if widest else _first_closed(inner)
        return F.when(F.contains(inner, F.lit("{")), _let(part, lambda p: F.when(p.isNotNull(), _object_or(p, none))))

    def read(bare: Column) -> Column:
        inner = F.when(F.contains(bare, F.lit("```")) & bare.rlike(block), trimmed(F.regexp_extract(bare, block, 1))).otherwise(bare)
        return _let(inner, lambda i: F.when(i != "", _object_or(i, within(i))))

    return _let(trimmed(F.regexp_replace(text, r"(?is)<think>.*?</think>", "")), read)


def faq(question: Column) -> Column:
    """struct(answer, section) of the first keyword set that occurs in the question, or null."""
    q = F.lower(F.coalesce(question, F.lit("")))
    cases = []
    for name, section, words in patterns.ANSWERS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        cases.append(F.when(hit, F.struct(F.lit(name).alias("answer"), F.lit(section).alias("section"))))
    return F.coalesce(*cases)


_HEADING = r"(\d{1,2})\.\s+([A-Z][^\n]{3,90})"


def sections(document: Column, known: tuple[str, ...] = tuple(map(str, range(1, 11)))) -> Column:
    """array of (section_id, title, text) of a document with headings such as ``5. Refunds``.

    A heading has a number of ``known`` that no earlier heading has, and a title
    that starts with a capital. Other numbered lines, such as those of a list,
    belong to the section they stand in; what comes before the first heading to
    none.
    """
    flat = F.concat(F.lit("\n"), F.regexp_replace(document, r"[ \t]+", " "))
    pieces = F.slice(F.split(flat, r"\n(?=\s*\d{1,2}\.\s+[A-Z][^\n]{3,90})"), 2, 1 << 30)
    take = lambda p, k: F.regexp_extract(p, rf"(?s)^\s*{_HEADING}(.*)$", k)
    found = "array<struct<section_id:string,title:string,text:string>>"

    def add(acc: Column, p: Column) -> Column:
        new = take(p, 1).isin(*known) & ~F.exists(acc, lambda s: s["section_id"] == take(p, 1))
        own = F.struct(take(p, 1).alias("section_id"), F.trim(take(p, 2)).alias("title"), take(p, 3).alias("text"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["section_id"].alias("section_id"), last["title"].alias("title"), F.concat(last["text"], F.lit("\n"), p).alias("text"))
        return F.when(new, F.array_append(acc, own)).when(F.size(acc) == 0, acc).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer))

    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    joined = F.aggregate(pieces, F.array().cast(found), add)
    return F.transform(joined, lambda s: F.struct(s["section_id"].alias("section_id"), s["title"].alias("title"), clean(s["text"]).alias("text")))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def quote_found(source: Column, quote: Column) -> Column:
    """Whether a source has a quote, by its letters and digits alone: case, white space, punctuation and quote marks do not count.

    A quote may join clauses that the source has apart: it is found too if it has
    stretches of over 40 characters between its words of four or more, and the
    source has all of these.
    """
    needle, hay = _flat(quote), _flat(source)
    clauses = F.filter(F.split(needle, r" (?=[a-z0-9]{4})"), lambda c: F.length(c) > 40)
    return F.coalesce((F.length(needle) > 0) & (F.contains(hay, needle) | ((F.size(clauses) > 0) & F.forall(clauses, lambda c: F.contains(hay, c)))), F.lit(False))
