"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong findings stand on their own: assigned secrets, access identifiers, long
hexadecimal strings. Weak candidates (short assigned values, opaque strings,
user or client identifiers) mean little alone. They are joined with their
complementary parts by interval: within a scope of ``reach`` code points of the
same text, a weak secret needs an identifier or an endpoint beside it, a weak
identifier needs a secret.

A scope never leaves its text, so the interval join runs inside the row: parts
are sorted by start, a running maximum of their ends is kept, and each candidate
looks up by bisection how many parts start before its interval ends. It has a
partner if the largest end among those reaches its interval. That takes n log n
for n parts of a text and needs no shuffle at all, of texts or of offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import fresh, table


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "([A-Za-z0-9+/_.=-]+)"

# The base kinds, in the order in which they are listed.
#: kind: (pattern, group that is measured, its least length, strength, role)
BASE = {
    "assign": (f"({_either_case('password|passwd|secret|token|api_?key')}){_ASSIGN}{_VALUE}", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
#: Weak candidates and evidence. Roles: secret, identifier, endpoint.
PARTS = {
    "weak_secret": (f"({_either_case('password|passwd|passphrase|passcode|pwd|secret|token|api_?key')}){_ASSIGN}{_VALUE}", 2, 6),
    "opaque": ("[A-Za-z0-9+/]{32,}", 0, 32),
    "identifier": (f"({_either_case('username|user|login|account|client_?id|key_?id')}){_ASSIGN}([A-Za-z0-9@._+-]+)", 2, 3),
    "endpoint": (r"[a-z][a-z0-9+.-]*://[^\x00-\x20\x22'<>]+", 0, 8),
}
REACH = 200
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_POWERS = [1 << k for k in range(31)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _powers_up_to(n: Column) -> Column:
    return F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p <= n)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The fold of every element with all before it, in passes that double their stride."""
    return _let(
        values,
        lambda v: F.aggregate(
            _powers_up_to(F.size(v)),
            v,
            lambda a, p: F.transform(a, lambda x, i: F.when(i >= p, combine(x, F.get(a, i - p))).otherwise(x)),
        ),
    )


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """array of (start, rank, end, kind) of the leftmost non-overlapping matches long enough, in code points.

    The pieces between the matches give the offsets: a match ends after all
    pieces and matches up to it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    fits = lambda found: F.length(found) >= least
    if kind == "opaque":  # a string of one sort of letters is a word or a number, not a key
        fits = lambda found: (F.length(found) >= least) & found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
    pieces = F.struct(
        F.transform(F.split(text, pattern), F.length).alias("gaps"),
        F.transform(whole, F.length).alias("sizes"),
        F.transform(measured, fits).alias("fit"),
    )

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p["sizes"], lambda n, i: n + F.get(p["gaps"], i)), lambda a, b: a + b)
        made = F.transform(
            F.arrays_zip(ends.alias("end"), p["sizes"].alias("size"), p["fit"].alias("fit")),
            lambda m: F.when(m["fit"], F.struct((m["end"] - m["size"]).alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))),
        )
        return F.array_compact(made)

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(F.array().cast(_SPAN))


def _beside(spans: Column, parts: Column, reach: int, wanted: bool = True) -> Column:
    """Those of ``spans`` that have one of ``parts`` within ``reach`` code points (-1: overlapping), or those that have none."""

    def search(z: Column) -> Column:
        def meets(s: Column) -> Column:
            before = F.aggregate(  # how many parts start early enough
                z["powers"], F.lit(0), lambda k, p: F.when((k + p <= F.size(z["starts"])) & (F.get(z["starts"], k + p - 1) <= s["end"] + reach), k + p).otherwise(k)
            )
            return _let(before, lambda k: (k > 0) & (F.get(z["ends"], k - 1) >= s["start"] - reach))

        return F.filter(spans, lambda s: F.coalesce(meets(s), F.lit(False)) == F.lit(wanted))

    ordered = lambda p: F.struct(
        F.transform(p, lambda x: x["start"]).alias("starts"),
        _running(F.transform(p, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("ends"),
        F.reverse(_powers_up_to(F.size(p))).alias("powers"),
    )
    empty = spans if not wanted else F.array().cast(_SPAN)
    return F.when((F.size(spans) > 0) & (F.size(parts) > 0), _let(_let(F.array_sort(parts), ordered), search)).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _scan(text: Column, reach: int) -> Column:
    """struct(base, spans) of a text that is not null."""
    each = {kind: _spans(text, kind, rank, *rule) for rank, (kind, rule) in enumerate((BASE | PARTS).items())}

    def candidates(f: Column) -> Column:
        base = F.array_sort(F.concat(*[f[k] for k in BASE]))
        taken = F.concat(base, f["weak_secret"])
        secrets = F.concat(_beside(f["weak_secret"], base, -1, False), _beside(f["opaque"], taken, -1, False))
        identifiers = _beside(f["identifier"], base, -1, False)
        return F.struct(base.alias("base"), secrets.alias("secrets"), identifiers.alias("identifiers"), f["assign"].alias("assign"), f["access"].alias("access"), f["endpoint"].alias("endpoint"))

    def linked(c: Column) -> Column:
        of_secrets = _beside(c["secrets"], F.concat(c["identifiers"], c["endpoint"], c["access"]), reach)
        of_identifiers = _beside(c["identifiers"], F.concat(c["secrets"], c["assign"]), reach)
        return F.struct(c["base"].alias("base"), F.array_sort(F.concat(c["base"], of_secrets, of_identifiers)).alias("spans"))

    return _let(_let(F.struct(*[c.alias(k) for k, c in each.items()]), candidates), linked)


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, sorted arrays of (start, rank, end, kind); end is exclusive.

    A null text is empty and has no spans. Each row is judged by its own text
    alone, so repeated rows and rows that share a doc_id, null or not, each get
    their spans. Columns named base or spans are replaced, others of any name
    stay; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    (found,) = fresh(docs, "found")
    scanned = docs.select(*[F.col(f"`{c}`") for c in keep], _scan(F.coalesce(F.col("text"), F.lit("")), reach).alias(found))
    return scanned.select(*[F.col(f"`{c}`") for c in keep], F.col(found)["base"].alias("base"), F.col(found)["spans"].alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with its sorted ``spans`` replaced by ``mask``; overlapping ones become one.

    Pieces are cut from four bytes a code point, where a place is found at once.
    """

    def cut(z: Column) -> Column:
        starts, ends, wide = z["starts"], z["ends"], z["wide"]
        piece = lambda at, to: F.decode(F.substring(wide, at * 4 + 1, (to - at) * 4), "UTF-32")
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        pieces = F.array_compact(F.transform(starts, lambda s, i: F.when(s >= before(i), piece(before(i), s))))
        rest = piece(F.get(ends, F.size(ends) - 1), F.floor(F.octet_length(wide) / 4).cast("int"))
        return F.array_join(F.concat(pieces, F.array(rest)), mask)

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    parts = F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), ends.alias("ends"), F.encode(text, "UTF-32").alias("wide"))
    return F.when(F.size(spans) > 0, _let(parts, cut)).otherwise(text)


def redact(docs: DataFrame, mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``; overlapping spans become one. n_chars follows, where it is a column.

    A null text stays null, a text without spans stays as it is, with its
    n_chars. Rows are masked one by one, so repeated rows and doc_ids, null ones
    included, make no difference. All columns stay in their order, whatever their
    names; an empty table gives an empty result.
    """
    text, spans = fresh(docs, "text", "spans")
    scanned = docs.select("*", F.col("text").alias(text), _scan(F.coalesce(F.col("text"), F.lit("")), reach)["spans"].alias(spans))
    changed = {"text": masked(F.col(text), F.col(spans), mask)}
    out = scanned.withColumn("text", changed["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(text, spans)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos AS span_start, pos + length(hit) AS span_end FROM (
      SELECT doc_id, hit, measured,
             sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM (SELECT doc_id,
                   unnest(regexp_extract_all(text, '{p}', 0)) AS hit,
                   unnest(regexp_extract_all(text, '{p}', {group})) AS measured,
                   unnest(list_slice(string_split_regex(text, '{p}'), 1, -2)) AS gap,
                   unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS k
            FROM docs WHERE regexp_matches(text, '{p}'))
      WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))
    WHERE length(measured) >= {least}"""


_SQL_KINDS = {kind: _sql_spans(kind, rank, *rule) for rank, (kind, rule) in enumerate((BASE | PARTS).items())}
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({' UNION ALL '.join(_SQL_KINDS[k] for k in BASE)}),
secrets AS ({_SQL_KINDS['weak_secret']}),
opaque AS (SELECT o.* FROM ({_SQL_KINDS['opaque']}) o JOIN docs d USING (doc_id)
  WHERE regexp_matches(substring(d.text, CAST(span_start AS BIGINT) + 1, CAST(span_end - span_start AS BIGINT)), '[A-Z]')
    AND regexp_matches(substring(d.text, CAST(span_start AS BIGINT) + 1, CAST(span_end - span_start AS BIGINT)), '[a-z]')
    AND regexp_matches(substring(d.text, CAST(span_start AS BIGINT) + 1, CAST(span_end - span_start AS BIGINT)), '[0-9]')),
identifiers AS ({_SQL_KINDS['identifier']}),
endpoints AS ({_SQL_KINDS['endpoint']}),
taken AS (SELECT * FROM base UNION ALL SELECT * FROM secrets),
weak AS (
  SELECT *, 'secret' AS role FROM secrets s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND s.span_start < b.span_end AND b.span_start < s.span_end)
  UNION ALL
  SELECT *, 'secret' FROM opaque s WHERE NOT EXISTS (SELECT 1 FROM taken b WHERE b.doc_id = s.doc_id AND s.span_start < b.span_end AND b.span_start < s.span_end)
  UNION ALL
  SELECT *, 'identifier' FROM identifiers s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND s.span_start < b.span_end AND b.span_start < s.span_end)),
beside AS (
  SELECT * FROM weak UNION ALL SELECT *, 'endpoint' FROM endpoints
  UNION ALL SELECT *, CASE kind WHEN 'access' THEN 'identifier' ELSE 'secret' END FROM base WHERE kind IN ('access', 'assign')),
linked AS (
  SELECT doc_id, rank, kind, span_start, span_end FROM weak w WHERE EXISTS (
    SELECT 1 FROM beside p WHERE p.doc_id = w.doc_id
      AND ((w.role = 'secret' AND p.role <> 'secret') OR (w.role = 'identifier' AND p.role = 'secret'))
      AND greatest(p.span_start - w.span_end, w.span_start - p.span_end) <= {REACH})),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM linked),
label AS (SELECT *, kind || ':' || CAST(span_start AS BIGINT) || ':' || CAST(span_end AS BIGINT) AS said FROM everything)
SELECT d.doc_id,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY span_start, rank) FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY span_start, rank), '') AS spans,
  count(*) FILTER (WHERE rank >= {len(BASE)}) AS n_linked
FROM docs d LEFT JOIN label l ON l.doc_id = d.doc_id
GROUP BY d.doc_id
"""

QUERIES = {"op1_secrets": op1_secrets}
ORACLES = {"op1_secrets": SQL}
