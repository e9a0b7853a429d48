import hashlib
import random

from pyspark.sql import functions as F

from tallyforge.llm import fingerprints as fp


def brute(rows):
    """Rows (doc_id, text) in the contract's order with their edited texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        out.append((doc, text, text[: len(text) - k] + other[:k], other))
    return out


def check(df):
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(e), fp.fingerprint(o)) for d, t, e, o in brute([(r["doc_id"], r["text"] or "") for r in df.collect()]))
    got = sorted((str(r["doc_id"]), *list(r)[1:]) for r in fp.with_next(df).collect())
    assert got == want


def test_against_brute_force(odd, documents):
    check(odd)
    check(documents)
    assert fp.with_next(odd.limit(0)).count() == 0
    check(odd.where("doc_id = 6"))


def test_likeness_separates(documents):
    found = fp.with_next(documents).select(fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("e"), fp.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("n")).toPandas()
    assert found["e"].between(0, 1).all() and found["n"].between(0, 1).all()
    assert found["e"].median() > 0.55 and found["n"].quantile(0.95) < 0.3


def test_equal_texts_and_edits(spark):
    a = "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(4000))
    assert fp.fingerprint(a) == fp.fingerprint(a) and fp.fingerprint("") == fp.fingerprint(None)
    b = a[:2000] + "changed here" + a[2010:]
    row = spark.createDataFrame([(fp.fingerprint(a), fp.fingerprint(b))], "a string, b string").select(fp.likeness(F.col("a"), F.col("b"))).first()
    assert row[0] > 0.85


def slow_fingerprint(text):
    """The same hash written down byte by byte, with whole numbers."""
    data, wide, narrow = (text or "").encode(), (1 << 64) - 1, (1 << 32) - 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolled = []
    for i in range(len(data)):
        x = sum((data[i - k] + 1) * pow(0x01000193, k) for k in range(7) if i >= k) & narrow
        x ^= x >> 15
        x = x * 0x85EBCA6B & narrow
        rolled.append(x ^ x >> 13)
    mixed = [(m := x * 0xC2B2AE3D27D4EB4F & wide) ^ m >> 29 for x in rolled]

    def cuts(block):
        return [i for i, x in enumerate(rolled) if x % block == block - 1]

    def digits(ends):
        chunks, chunk = [], []
        for i, m in enumerate(mixed):
            chunk.append(m)
            if i in ends:
                chunks.append(chunk)
                chunk = []
        chunks += [chunk] if chunk else []
        said = lambda sums: letters[(sum(sums) & wide) * 0x9E3779B97F4A7C15 % (1 << 64) >> 58]
        told, at = "", 0
        while at < len(chunks):
            n = 1
            while at + n < len(chunks) and sum(chunks[at + n]) & wide == sum(chunks[at]) & wide:
                n += 1
            count, left = "", n if n > 1 else 0
            while left:
                count, left = letters[left % 64] + count, left // 64
            told += said(chunks[at]) + (f"*{count}" if n > 1 else "")
            at += n
        return told

    def count_runs(ends):
        sums, total = [], 0
        for i, m in enumerate(mixed):
            total += m
            if i in ends or i == len(mixed) - 1:
                sums.append(total & wide)
                total = 0
        return sum(1 for k, x in enumerate(sums) if not k or x != sums[k - 1])

    block = 4
    while block * 64 < len(data):
        block *= 2
    while block > 4 and len(cuts(block)) < 32:
        block //= 2
    if not data:
        return "4::"
    while count_runs(set(cuts(block))) > 64 and len(cuts(2 * block)) >= 32:
        block *= 2
    return f"{block}:{digits(set(cuts(block)))}:{digits(set(cuts(2 * block)))}"


def slow_likeness(a, b):
    if a == b:
        return 1.0
    (m, x1, x2), (n, y1, y2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    x, y = (x1, y1) if m == n else (x1, y2) if m == 2 * n else (x2, y1) if 2 * m == n else ("", "")
    if not x and not y:
        return 0.0
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return 1.0 - row[-1] / max(len(x), len(y))


def test_fingerprints_and_likeness_equal_the_slow_way(spark):
    rng = random.Random(4)
    texts = ["", "a", "abcdefg", "x" * 3000, "line\n" * 400, "é\U0001f600" * 300] + ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([50, 300, 2000, 6000]))) for _ in range(12)]
    texts += [t[: len(t) // 2] + "edited" + t[len(t) // 2 + rng.randint(0, 9) :] for t in texts[6:]] + [t * 2 for t in texts[6:12]]
    prints = [fp.fingerprint(t) for t in texts]
    assert prints == [slow_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in prints for b in prints]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(abs(r["l"] - slow_likeness(r["a"], r["b"])) < 1e-12 for r in got) and any(0.3 < r["l"] < 1 for r in got)


def test_no_part_of_a_text_is_left_out():
    lines = [f"line {i % 97} of a list\n" for i in range(3000)]
    text = "".join(lines)
    late = "".join(lines[:2990] + ["another line\n"] + lines[2991:])
    assert fp.fingerprint(text) != fp.fingerprint(late)
    assert len({fp.fingerprint("the same line\n" * n) for n in (100, 101, 150, 5000)}) == 4
    assert len(fp.fingerprint("the same line\n" * 100_000)) < 100
