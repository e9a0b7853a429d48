"""URL filtering by curated rules and, where none fits, by mined association rules.

The urls that a curated rule decides are the labelled transactions: their tokens
(host labels, path segments, query keys) and their verdict. Spark's FP-growth
finds the frequent token combinations; those that imply a verdict with enough
confidence become rules. Each mined rule is indexed under its rarest token, so a
url meets only the rules one of whose tokens it holds, and is then tested for
the rest. The rule with the highest confidence, then support, decides.

A rule has ``MAX_TOKENS`` tokens at most and at least ``MIN_COUNT`` labelled urls
behind it. FP-growth lists every frequent combination, of whatever length, so
transactions are cut before it sees them, in ways that change no verdict:
infrequent tokens are in no rule; tokens that the same labelled urls have are one
*class*, since rules on either are worth the same; a token that has one verdict
without any exception is a rule by itself, which no longer rule outranks. Where
more than ``WHOLE`` classes are left, they are put into small groups, and a url
becomes one transaction for each choice of up to ``MAX_TOKENS`` of its groups,
with the tokens of these alone. A rule is counted in the choice that its own
tokens make, where all urls that hold it are, so counts stay exact, and no
transaction has more than a few tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, fresh, table

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
MAX_TOKENS = 3
MIN_COUNT = 5
#: Open classes up to which urls are mined whole, and classes of a group beyond.
WHOLE, GROUP = 12, 2
DEFAULT = "allow"
_CHUNK = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; empty for null or where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    take = lambda k: F.regexp_extract(text, _AFTER_SCHEME, k)
    return F.translate(take(1), _UPPER, _LOWER), take(2), take(3)


def curated(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(host: Column, path: Column, query: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments by place (numbers by their first digit), query keys."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    number = lambda s: F.regexp_replace(s, r"^([0-9])[0-9]*", "$1#")
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), number(s)))
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, "(?s)^[^=]*", 0)))
    return F.array_sort(F.array_distinct(F.concat(F.filter(labels, lambda x: x != "h:"), segments, keys)))


def least_count(total: Column, min_support: float, min_count: int) -> Column:
    """How many labelled urls a rule needs."""
    return F.greatest(F.lit(min_count).cast("long"), F.ceil(F.lit(min_support) * total))


def token_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT) -> DataFrame:
    """(token, class, n, verdict, share, total) of the frequent tokens of ``labelled`` (tokens, verdict, n).

    class: the smallest of the tokens that the same rows have; n: rows with it;
    verdict and share: its most frequent verdict and how frequent; total: all
    labelled rows. There are at most the mean number of
    tokens by ``min_support`` of them.
    """
    total = labelled.agg(F.sum("n").alias("total"))
    marks = [F.bit_xor(F.xxhash64("tokens", "verdict", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]  # rows are distinct, so that marks tell sets of rows apart
    each = labelled.select("tokens", "verdict", "n", F.explode("tokens").alias("token"))
    by_token = each.groupBy("token").agg(F.sum("n").alias("n"), *marks)
    by_verdict = each.groupBy("token", "verdict").agg(F.sum("n").alias("nv")).crossJoin(total)  # one row
    most = by_verdict.groupBy("token").agg(F.max(F.struct("nv", "verdict")).alias("most"), F.any_value("total").alias("total"))
    frequent = by_token.join(most, "token").where(F.col("n") >= least_count(F.col("total"), min_support, min_count))
    named = frequent.groupBy("n", "mark1", "mark2").agg(F.min("token").alias("class"))
    return frequent.join(named, ["n", "mark1", "mark2"]).select("token", "class", "n", F.col("most.verdict").alias("verdict"), (F.col("most.nv") / F.col("n")).alias("share"), "total")


def _choices(groups: str, most: int) -> Column:
    """Every choice of 1 to ``most`` of the sorted ``groups``."""
    sets = [F.expr(f"transform({groups}, g -> array(g))")]
    for _ in range(1, most):
        larger = F.flatten(F.transform(sets[-1], lambda c: F.transform(F.filter(F.col(groups), lambda g: g > F.element_at(c, -1)), lambda g: F.array_append(c, g))))
        sets.append(larger)
    return F.concat(*sets)


def mine_rules(labelled: DataFrame, classes: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, min_count: int = MIN_COUNT, whole: int = WHOLE) -> DataFrame:
    """(tokens, anchor, verdict, confidence, support) from ``labelled`` (tokens, verdict, n) and its ``classes``; tokens are classes, anchor is the rarest.

    Rules have up to ``max_tokens`` tokens. Without frequent tokens there are none.
    """
    one = classes.where("token = class")
    pure = one.where("share = 1").select(F.array("class").alias("tokens"), F.col("class").alias("anchor"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / F.col("total")).alias("support"))
    ranked = one.where("share < 1").select("class", F.col("class").alias("token"), (F.row_number().over(Window.orderBy("class")) - 1).alias("rank"))  # bounded, see token_classes
    n_open = ranked.count()
    if not n_open:
        return pure
    open_ = ranked.withColumn("group", F.lit(0) if n_open <= whole else F.floor(F.col("rank") / GROUP).cast("int"))
    met = labelled.select("tokens", "verdict", "n", F.explode("tokens").alias("token")).join(F.broadcast(open_), "token").groupBy("tokens", "verdict", "n")
    held = met.agg(F.array_sort(F.collect_list(F.struct("group", "class"))).alias("held")).withColumn("groups", F.array_distinct(F.transform("held", lambda h: h["group"])))
    chosen = held.select("verdict", "n", "held", F.explode(_choices("groups", max_tokens)).alias("choice")).withColumn("name", F.array_join("choice", "-"))
    item = lambda h: F.concat("name", F.lit("|"), h["group"], F.lit("|"), h["class"])
    tokens = F.transform(F.filter("held", lambda h: F.array_contains("choice", h["group"])), item)
    sets = chosen.select(F.concat(tokens, F.array(F.concat("name", F.lit("|="), "verdict"))).alias("items"), "n")
    # a set counts as often as rows have it; many copies are made in many tasks
    chunks = sets.select("items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))).alias("chunk")).repartition("items", "chunk")
    items = chunks.select("items", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(_CHUNK), F.col("n") - F.col("chunk") * _CHUNK).cast("int")))).select("items")
    size = sets.agg(F.sum("n").alias("made")).crossJoin(classes.agg(F.max("total").alias("total"))).select("made", "total", least_count(F.col("total"), min_support, min_count).alias("least")).first()  # one row each
    model = FPGrowth(itemsCol="items", minSupport=(size["least"] - 0.5) / size["made"], minConfidence=min_confidence).fit(items)
    part = lambda x, k: F.get(F.split(x, r"\|", 3), F.lit(k))
    own = F.array_join(F.array_sort(F.array_distinct(F.transform("antecedent", lambda x: part(x, 1).cast("int")))), "-")
    rules = (
        model.associationRules.where(part(F.col("consequent")[0], 1).startswith("=") & (F.size("antecedent") <= max_tokens))
        .where(own == part(F.col("consequent")[0], 0))  # else the choice lacks urls that hold the rule
        .select(
            F.array_sort(F.transform("antecedent", lambda x: part(x, 2))).alias("tokens"), F.expr("substring(split(consequent[0], '[|]', 2)[1], 2)").alias("verdict"),
            "confidence", (F.round(F.col("support") * size["made"]) / size["total"]).alias("support"),
        )
    )
    counted = one.select(F.col("class").alias("token"), "n")
    anchors = rules.select("tokens", F.explode("tokens").alias("token")).join(counted, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("rarest"))
    return rules.join(anchors, "tokens").select("tokens", F.col("rarest.token").alias("anchor"), "verdict", "confidence", "support").union(pure)


def mined_verdicts(scratch: Scratch, sets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, min_count: int = MIN_COUNT, whole: int = WHOLE) -> DataFrame | None:
    """(tokens, verdict) of the sets of ``sets`` (tokens, verdict, n) that have no verdict and meet a mined rule; None where nothing is labelled."""
    labelled = sets.where("verdict is not null and size(tokens) > 0")
    if labelled.isEmpty():
        return None
    classes = scratch.save(token_classes(labelled, min_support, min_count), "classes")
    rules = scratch.save(mine_rules(labelled, classes, min_support, min_confidence, max_tokens, min_count, whole), "rules")
    known = F.broadcast(classes.select("token", "class"))  # bounded, see token_classes
    asked = sets.where("verdict is null and size(tokens) > 0").select("tokens", F.explode("tokens").alias("token")).join(known, "token")
    held = asked.groupBy("tokens").agg(F.collect_set("class").alias("held"))
    meets = held.select("tokens", "held", F.explode("held").alias("anchor")).join(rules.withColumnRenamed("tokens", "rule"), "anchor").where(F.size(F.array_except("rule", "held")) == 0)
    best = meets.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
    return scratch.save(best.select("tokens", F.col("best.verdict").alias("verdict")), "verdicts")


def judge(urls: DataFrame, rules=RULES, default: str = DEFAULT, **mining: float) -> DataFrame:
    """``urls`` with host, path, rule, verdict and ``by`` (rule, mined or default).

    Null urls and those without ``://`` have empty host and path, no tokens and
    the default verdict. Repeated rows keep a row each, and each counts in
    mining. Columns of these names are replaced, others of any name stay; an
    empty table gives an empty result.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    host, path, query = parts_of(F.col("url"))
    keep = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict", "by")]
    left, asked, found, tokens, mined = fresh(urls.drop("host", "path", "rule", "verdict", "by"), "left", "query", "found", "tokens", "mined")
    rows = urls.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), query.alias(asked)).withColumn(found, curated(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn(tokens, tokens_of(F.col("host"), F.col("path"), F.col(asked))).drop(asked)
    sets = scratch.save(rows.groupBy(F.col(tokens).alias("tokens"), F.col(found)["verdict"].alias("verdict")).agg(F.count("*").alias("n")), "sets")
    verdicts = mined_verdicts(scratch, sets, **mining)
    if verdicts is None:
        judged = rows.withColumn(mined, F.lit(None).cast("string"))
    else:
        judged = rows.join(verdicts.select(F.col("tokens").alias(left), F.col("verdict").alias(mined)), F.col(tokens) == F.col(left), "left")
    rule, said = F.col(found)["rule"], F.col(mined)
    by = F.when(rule.isNotNull(), "rule").when(said.isNotNull(), "mined").otherwise("default")
    return judged.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"), F.coalesce(F.col(found)["verdict"], said, F.lit(default)).alias("verdict"), by.alias("by"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
)
_SAYS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
SQL = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 2) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 3) AS query
  FROM pages),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts),
said AS (SELECT *, CASE rule {_SAYS} END AS verdict FROM ruled),
segments AS (SELECT row, unnest(segs) AS s, unnest(range(len(segs))) AS i FROM (SELECT row, [x FOR x IN string_split(path, '/') IF x <> ''] AS segs FROM said)),
tokens AS (
  SELECT DISTINCT row, 'h:' || t AS token FROM (SELECT row, unnest(string_split(host, '.')) AS t FROM said) WHERE t <> ''
  UNION SELECT row, 'p' || i || ':' || regexp_replace(s, '^([0-9])[0-9]*', '\1#') FROM segments
  UNION SELECT row, 'q:' || regexp_extract(k, '(?s)^[^=]*', 0) FROM (SELECT row, unnest(string_split(query, '&')) AS k FROM said) WHERE k <> ''),
learnt AS (SELECT t.row, t.token, s.verdict FROM tokens t JOIN said s ON s.row = t.row WHERE s.verdict IS NOT NULL),
total AS (SELECT count(DISTINCT row) AS n FROM learnt),
sets AS (
  SELECT row, verdict, [token] AS items FROM learnt
  UNION ALL SELECT a.row, a.verdict, [a.token, b.token] FROM learnt a JOIN learnt b ON a.row = b.row AND a.token < b.token
  UNION ALL SELECT a.row, a.verdict, [a.token, b.token, c.token] FROM learnt a JOIN learnt b ON a.row = b.row AND a.token < b.token JOIN learnt c ON c.row = b.row AND b.token < c.token),
counts AS (SELECT items, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS whole FROM sets GROUP BY items, verdict),
mined AS (
  SELECT items, verdict, CAST(c.n AS DOUBLE) / CAST(whole AS DOUBLE) AS confidence, CAST(c.n AS DOUBLE) / CAST(total.n AS DOUBLE) AS support
  FROM counts c, total WHERE c.n >= greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * total.n)) AND CAST(c.n AS DOUBLE) / CAST(whole AS DOUBLE) >= {MIN_CONFIDENCE}),
held AS (SELECT row, list(token) AS have FROM tokens GROUP BY row),
best AS (
  SELECT h.row, arg_max(m.verdict, (m.confidence, m.support, m.verdict)) AS verdict
  FROM held h JOIN said s ON s.row = h.row AND s.verdict IS NULL JOIN mined m ON list_has_all(h.have, m.items) GROUP BY h.row)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.verdict, b.verdict, '{DEFAULT}') AS verdict,
  CASE WHEN s.verdict IS NOT NULL THEN 'rule' WHEN b.verdict IS NOT NULL THEN 'mined' ELSE 'default' END AS by
FROM said s LEFT JOIN best b ON b.row = s.row
"""

QUERIES = {"op3_urls": op3_urls}
ORACLES = {"op3_urls": SQL}
