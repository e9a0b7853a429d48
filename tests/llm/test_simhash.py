import random
import re

import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import Scratch


def brute_print(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near=2):
    label = dict(enumerate(range(len(prints))))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= near and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(odd, documents):
    for df in (odd, documents):
        for r, f in zip(df.collect(), simhash.fingerprints(df).collect()):
            assert f["fp"] % (1 << 64) == brute_print(r["text"])


def test_components(spark):
    rng = random.Random(3)
    prints = [0, 0]
    for _ in range(12):
        prints.append(rng.getrandbits(64))
    for _ in range(150):
        x = rng.choice(prints)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    want = brute_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    least = {}
    for i, p in enumerate(signed):
        least.setdefault(p, i)
    distinct = spark.createDataFrame(list(least.items()), "fp long, rep long")
    for crowd in (64, 2):  # the second sends nearly all through the exact other way
        scratch = Scratch(spark, "test")
        found = {r["node"]: r["component"] for r in connected_components(scratch, simhash.links(scratch, distinct, crowd)).collect()}
        assert all(found.get(least[p], least[p]) == want[i] for i, p in enumerate(signed))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3)], "a long, b long")
    found = connected_components(Scratch(spark, "test"), edges)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(301)}
    assert connected_components(Scratch(spark, "test"), edges.limit(0)).count() == 0


def test_documents(odd):
    got = {(r["id"], r["component"]) for r in simhash.simhash_components(odd).collect()}
    assert (1, 1) in got and (2, 1) in got and (3, 3) in got and (4, 3) in got and (5, 3) in got and (6, 6) in got
    assert simhash.simhash_components(odd).count() == odd.count()
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 9]
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def test_exploded_variants_are_not_broadcast(spark, monkeypatch):
    """Spark sizes 64 variants of a row as one; a table below its threshold would go to the driver 64 times over."""
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or save(self, df, name))
    scratch = Scratch(spark, "test")
    distinct = scratch.save(spark.createDataFrame([(i * 0x1234567, i) for i in range(50)] + [(1, 99)], "fp long, rep long"), "distinct")
    assert {tuple(r) for r in simhash.links(scratch, distinct).collect()} == {(0, 99)}
    assert "Generate" in plans["members"] and "Broadcast" not in plans["members"]
