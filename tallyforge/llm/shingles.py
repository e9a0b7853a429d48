"""Near-duplicates by exact similarity of word shingles.

Two texts are linked where the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Links may be found ahead by another method (see
``simhash``) and are then taken once their sets agree; the rest, and all where
there is none, come from prefixes: with all shingles in one fixed order,
frequent ones last, two such sets share a shingle among the first
n - ceil(0.8 n) + 1 of each. Texts that meet in a prefix shingle and are not
connected yet are joined by equality, a pair's meetings are counted, and pairs
whose count still allows the similarity are verified by their whole sets. So no
link is lost and none is false.

A prefix shingle of more than ``crowd`` texts is not expanded into pairs. Its
texts are compared with a few *pivots* first. The fewer shingles of its own a
text has, the earlier the shared one stands in its order, so the texts where it
stands first are in the middle of a crowd of near copies, and link with all that
are similar to any of them, or nearly so. What these leave apart gets pivots from
outside the largest component in the same way. Of those that are still in
different components, whoever is not in the largest one is joined with the
others, and only where places allow it: the first shingle that two similar sets
share stands, on average, within the first ninth of them, so of two texts one
must have it there.

Equal texts are one *node*, named by a hash of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import Scratch, batches, beside

WORDS = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
SEED = 42
#: Rows from which frequent shingles are estimated; they set the order only, which decides the cost and never the links.
_SAMPLE, _FREQUENT, _LISTED = 20_000, 4, 200_000
#: Pivots of a crowd at a time, the last drawn at random.
_PIVOTS = 3


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text with fewer words than a shingle has is one, an empty one has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[size - 1 :] - 1).tolist() or [len(joined)]
    starts = [0, *ends[: len(stops) - 1].tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles, as signed numbers."""
    return np.unique(shingle_hashes(text, size).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of some hashes: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that several rows of a sample share, the most frequent last; at most ``_LISTED`` reach the driver."""
    n = docs.count()
    rows = docs if n <= _SAMPLE else docs.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < int(_SAMPLE / n * (1 << 30)))
    sets = F.pandas_udf(lambda texts: pd.Series([shingle_set(t) for t in texts]), "array<long>")
    shared = rows.select(F.explode(sets("text")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT)
    with batches(docs.sparkSession):
        top = shared.orderBy(F.col("n").desc(), "key").limit(_LISTED).collect()
    return np.array([r["key"] for r in reversed(top)], dtype=np.int64)


def prints_of(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(id, mark, node, n, fp, keys) of rows (id, text), saved.

    mark: hash of the text as it is; node: of its words, the same for no two
    different ones; n: shingles; fp: their SimHash; keys: their prefix.
    """
    frequent = frequent_shingles(docs)
    by_key = np.argsort(frequent)
    ordered = frequent[by_key]
    part, whole = LEAST

    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                hashes = shingle_hashes(text, WORDS)
                found = np.unique(hashes.view(np.int64))
                rank = np.full(len(found), -1)
                if len(ordered) and len(found):
                    at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
                    rank = np.where(ordered[at] == found, by_key[at], -1)
                kept = found[np.lexsort((found, rank))][: len(found) + (-part * len(found)) // whole + 1] if len(found) else found
                fp = np.array([majority(hashes)], np.uint64).view(np.int64)[0]
                out.append((xxhash.xxh3_128_digest(b" ".join(words_of(text))), len(found), fp, kept))
            yield pd.DataFrame(out, columns=["digest", "n", "fp", "keys"])

    seen = F.pandas_udf(fold, "digest binary, n int, fp long, keys array<long>")
    with batches(scratch.spark):
        prints = scratch.save(docs.select("id", F.xxhash64("text").alias("mark"), seen("text").alias("p")).select("id", "mark", F.xxhash64("p.digest").alias("node"), "p.*"), "prints")
    two = prints.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("node", F.col("b").alias("digest"))
    two = scratch.save(two, "two")  # different texts of one hash, hardly ever any
    if two.isEmpty():
        return prints.drop("digest")
    again = prints.join(F.broadcast(two.select("node").distinct().withColumn("_twice", F.lit(True))), "node", "left")
    return scratch.save(again.withColumn("node", F.when(F.col("_twice"), F.xxhash64(F.hex("digest"))).otherwise(F.col("node"))).drop("_twice", "digest"), "prints-again")


def _sizes_fit(a: Column, b: Column) -> Column:
    part, whole = LEAST
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _left(n: Column) -> Column:
    """How many shingles are not in the prefix of a set of ``n``."""
    return F.ceil(n * LEAST[0] / LEAST[1]).cast("int") - 1


def verified(scratch: Scratch, docs: DataFrame, prints: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b), nodes, whose texts are similar. A set is made once for each node that is asked for."""
    pairs = scratch.save(pairs.select("a", "b").where("a <> b").distinct(), f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = prints.select("node", "id", "mark").join(beside(scratch.save(asked, f"{name}-asked")), "node")
    wanted = scratch.save(rows.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("row")).select("node", "row.*"), f"{name}-wanted")
    set_of = F.pandas_udf(lambda texts: pd.Series([shingle_set(t).tobytes() for t in texts]), "binary")
    sets = docs.withColumn("mark", F.xxhash64("text")).join(beside(wanted), ["id", "mark"]).select("node", set_of("text").alias("set"))
    with batches(scratch.spark):
        sets = scratch.save(sets.groupBy("node").agg(F.any_value("set").alias("set")), f"{name}-sets")

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        part, whole = LEAST
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            out.append((part + whole) * len(np.intersect1d(x, y, assume_unique=True)) >= part * (len(x) + len(y)))
        return pd.Series(out, dtype=bool)

    side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.pandas_udf(alike, "boolean")("set_a", "set_b"))
    with batches(scratch.spark):
        found = scratch.save(both.select("a", "b"), name)
    for done in ("pairs", "asked", "wanted", "sets"):
        scratch.drop(f"{name}-{done}")
    return found


def _places_fit(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Whether two sets may be similar whose first common shingle stands at these places of their order."""
    part, whole = LEAST
    return ((part + whole) * (na - pa) >= part * (na + nb)) & ((part + whole) * (nb - pb) >= part * (na + nb))


def _apart(scratch: Scratch, members: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(key, node, n, pos, part, size) of keys that nodes of different components have; part is a node's component so far."""
    own = Scratch(scratch.spark, name)
    found = connected_components(own, edges)
    m = F.col
    placed = members.alias("m").join(beside(found).alias("f"), m("m.node") == m("f.node"), "left").select("m.key", "m.node", "m.n", "m.pos", F.coalesce("f.component", "m.node").alias("part"))
    open_ = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    saved = scratch.save(placed.join(open_, "key"), name)
    own.drop()
    return saved


def links(scratch: Scratch, docs: DataFrame, prints: DataFrame, edges: DataFrame, crowd: int = 64) -> DataFrame:
    """Edges (a, b) between nodes that, with ``edges``, connect whatever all links connect."""
    postings = prints.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    # Spark sizes both sides as if nothing were exploded, and would broadcast the keys of a small table
    members = scratch.save(postings.join(shared.hint("merge"), "key", "left_semi").select("key", "node", "n", "pos").distinct(), "members")
    open_ = _apart(scratch, members, edges, "open")
    scratch.drop("members")
    few, many = open_.where(F.col("size") <= crowd), open_.where(F.col("size") > crowd)
    part, whole = LEAST
    at = lambda side, c: F.col(f"{side}.{c}")
    sizes = _sizes_fit(at("a", "n"), at("b", "n")) & (at("a", "part") != at("b", "part"))
    places = _places_fit(at("a", "n"), at("a", "pos"), at("b", "n"), at("b", "pos"))
    ends = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]

    # shingles of a crowd are not counted here: a pair may meet in as many as the one that has fewer of them
    crowded = many.groupBy("node").agg(F.count("*").alias("crowded"))
    told = few.join(beside(scratch.save(crowded, "crowded")), "node", "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    met = told.alias("a").join(told.alias("b"), "key").where(sizes & (at("a", "node") < at("b", "node")))
    met = met.select(*ends, at("a", "n").alias("na"), at("b", "n").alias("nb"), F.least("a.crowded", "b.crowded").alias("beyond"), places.alias("fits"))
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.max("beyond").alias("beyond"), F.bool_or("fits").alias("fits"))
    most = F.col("met") + F.col("beyond") + F.greatest(_left(F.col("na")), _left(F.col("nb")))
    # a pair whose first meeting is in a crowd is found there
    pairs = counted.where(F.col("fits") & ((part + whole) * most >= part * (F.col("na") + F.col("nb")))).select("a", "b")
    crowds = not many.isEmpty()

    def with_pivots(candidates: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs of a few of the ``candidates`` for each key with the ``rows`` of the key."""
        found = None
        for turn in range(_PIVOTS):
            drawn = F.xxhash64("node", F.lit(turn))
            first = F.struct("pos", drawn.alias("drawn")) if turn < _PIVOTS - 1 else drawn
            pivot = candidates.groupBy("key").agg(F.min_by(F.struct("node", "n", "pos", "part"), first).alias("p")).select("key", "p.*")
            met = pivot.alias("a").join(rows.alias("b"), "key").where(sizes & places).select(*ends)
            found = met if found is None else found.union(met)
        return found

    if crowds:
        pairs = pairs.union(with_pivots(many, many))
    edges = scratch.save(edges.union(verified(scratch, docs, prints, pairs, "near")), "edges")
    if not crowds:
        return edges

    def apart(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows of keys that are still open, and those of them that are not in their key's largest component."""
        rest = _apart(scratch, rows.select("key", "node", "n", "pos"), edges, name)
        largest = rest.groupBy("key", "part").agg(F.count("*").alias("in")).groupBy("key").agg(F.max(F.struct("in", "part")).alias("most")).select("key", F.col("most.part").alias("main"))
        return rest, rest.join(largest, "key").where("part <> main").drop("main")

    rest, small = apart(many, "rest")
    if rest.isEmpty():
        return edges
    more = verified(scratch, docs, prints, with_pivots(small, rest), "again")
    if not more.isEmpty():
        edges = scratch.save(edges.union(more), "edges-again")
        rest, small = apart(rest, "rest-again")
        if rest.isEmpty():
            return edges
    early = (part + whole) * F.col("pos") <= (whole - part) * F.col("n")
    one = small.where(early).alias("a").join(rest.alias("b"), "key").where(sizes & places).select(*ends)
    other = small.where(~early).alias("a").join(rest.where(early).alias("b"), "key").where(sizes & places).select(*ends)
    return edges.union(verified(scratch, docs, prints, one.union(other), "far"))


def shingle_rows(scratch: Scratch, docs: DataFrame, crowd: int = 64, ahead: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, mark, part) of rows (id, text), saved in ``scratch``: nodes that links connect have the same part.

    ``ahead`` may name pairs (a, b) of nodes that are worth a look first, from the prints.
    """
    own = Scratch(scratch.spark, "shingles")
    prints = prints_of(own, docs)
    suggested = ahead(prints) if ahead else prints.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    edges = links(own, docs, prints, verified(own, docs, prints, suggested, "ahead"), crowd)
    found = own.save(connected_components(Scratch(scratch.spark, "shingles"), edges), "components")
    placed = prints.join(beside(found), prints["node"] == found["node"], "left").select("id", "mark", F.coalesce("component", prints["node"]).alias("part"))
    placed = scratch.save(placed, "parts")
    own.drop()
    return placed


def shingle_components(docs: DataFrame, crowd: int = 64, ahead: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of rows (id, text): component is the smallest id reachable over links of similarity 0.8 or more.

    Texts with the same words are one; so are all that have none, null or blank.
    Ids are not null; different texts may share one. Repeated rows keep a row
    each; an empty table gives an empty result.
    """
    rows = shingle_rows(Scratch(docs.sparkSession, "shingles"), docs, crowd, ahead)
    least = rows.groupBy("part").agg(F.min("id").alias("component"))
    return rows.join(least, "part").select("id", "component")
