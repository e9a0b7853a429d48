import random

from tallyforge.llm import shingles, simhash
from tallyforge.llm.shared import Scratch
from tallyforge.scratch import path_of


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets, label = [brute_set(t) for _, t in rows], {i: i for i, _ in rows}
    linked = [(a, b) for i, (a, _) in enumerate(rows) for j, (b, _) in enumerate(rows[:i]) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    return label


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for size in (3, 5, 9, 40, 300, 300, 1000):
        base = [word() for _ in range(size)]
        for changes in (0, 0, 1, 1, 2, 4, 6, 9, 14, 20):
            copy = list(base)
            for _ in range(min(changes, size)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    texts += [f"{line} " + " ".join(word() for _ in range(rng.choice([1, 4, 30]))) for _ in range(40)]
    texts += ["", " \t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = corpus()
    want = brute_groups(rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    for crowd in (64, 2):  # the second sends nearly all by way of pivots and blocks
        assert {r["id"]: r["component"] for r in shingles.shingle_components(docs, crowd).collect()} == want


def test_the_stage_drops_copies_with_some_words_changed(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(1000)]
    rows = [(0, " ".join(base))]
    for i, changes in enumerate((1, 5, 10, 20), 1):
        copy = list(base)
        for at in rng.sample(range(1000), changes):
            copy[at] = f"x{at}"
        rows.append((i, " ".join(copy)))
    rows.append((5, " ".join(base[:500] + [f"y{k}" for k in range(500)])))
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 5]


def test_a_crowd_of_near_copies_is_linked_without_its_pairs(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    seen = []
    verify = shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda s, d, p, pairs, name: seen.append(pairs.distinct().count()) or verify(s, d, p, pairs, name))
    found = {r["id"]: r["component"] for r in shingles.shingle_components(spark.createDataFrame(rows, "id long, text string"), 16).collect()}
    assert found == brute_groups(rows) and len(set(found.values())) > 20
    assert sum(seen) < 12 * len(rows)  # of 79,800 pairs


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the keys of a text as one; those of a table below its threshold would go to the driver."""
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or save(self, df, name))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[::-1]))], "id long, text string")
    rows = shingles.shingle_rows(Scratch(spark, "test"), docs).collect()
    assert len({r["part"] for r in rows if r["id"] < 3}) == 1 and len({r["part"] for r in rows}) == 2
    assert "Generate" in plans["members"] and "Broadcast" not in plans["members"]


def test_tables_that_are_done_go(spark):
    """Of the tables on the way only what is read later stays."""
    scratch = Scratch(spark, "test")
    docs = scratch.save(spark.createDataFrame([(i, " ".join(f"w{i % 3}{k}" for k in range(20)) + f" {i}") for i in range(30)], "id long, text string"), "docs")
    prints = shingles.prints_of(scratch, docs)
    pairs = prints.alias("a").crossJoin(prints.alias("b")).selectExpr("a.node as a", "b.node as b")
    found = shingles.verified(scratch, docs, prints, pairs, "ahead")
    shingles.links(scratch, docs, prints, found)
    path, store = path_of(spark, scratch.path)
    assert {f.getPath().getName() for f in store.listStatus(path)} & {"ahead-pairs", "ahead-asked", "ahead-wanted", "ahead-sets", "near-pairs", "near-sets", "members"} == set()
    assert found.count() > 0
