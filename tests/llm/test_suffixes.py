import random
import time

import numpy as np
import pytest

from tallyforge.llm import suffixes


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        key = doc if doc is not None else float("inf")
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            first[w] = min(first.get(w, key), key)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        key = doc if doc is not None else float("inf")
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key:
                gone[i : i + 50] = [True] * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(doc), len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def check(df, **options):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, **options).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_odd_documents(odd):
    check(odd)
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)] + ["ab" * 60, "x" * 120]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) // 2))
            parts += [" ".join(word() for _ in range(rng.randint(0, 12))), s[a : a + rng.randint(30, len(s))]]
        rows.append((rng.choice([i, i, 5]), " ".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), crowd=[64, 1, 0][seed])


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 200)
    monkeypatch.setattr(suffixes, "_RUN", 700)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(2, text), (1, text[300:1100]), (3, text[::-1] + text[600:700])]
    # the workers import the module anew, so the pieces are tested where the tasks run: in this process
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    whole = suffixes.keys_of(data, *suffixes.segments(data, np.array([0, len(data)])))
    assert len(whole) and whole[:, -2].max() <= 50
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_merge_order():
    rng = random.Random(4)
    key = lambda: bytes(rng.choice(b"ab") for _ in range(suffixes._KEY))
    for n in (0, 1, 2, 3, 7):
        runs = [sorted({key()[:3] + b"z" * (suffixes._KEY - 3) for _ in range(rng.randint(0, 6))}) for _ in range(n)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), suffixes._KEY)
        shared = [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs]
        run, at, have = suffixes.merge_runs(runs, shared)
        merged = [runs[r][i] for r, i in zip(run, at)]
        assert merged == sorted(k for r in runs for k in r)
        assert list(have[1:]) == [common(a, b) for a, b in zip(merged, merged[1:])]


def test_texts_of_several_pieces(spark):
    """Texts longer than a piece and a run; what repeats is known by construction."""
    rng = random.Random(3)
    big = rng.randbytes(5 << 20).hex()
    assert len(big) > 2 * suffixes._PIECE
    edge = big[suffixes._PIECE - 300 : suffixes._PIECE + 300]
    rows = [(1, big), (2, "start " + edge + " end"), (3, big), (4, big[5_000_000:9_000_000] + "?" * 10)]
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and bytes(found[1]["kept"]).decode() == big
    assert found[2]["n_removed"] == 600 and bytes(found[2]["kept"]) == b"start  end"
    assert found[3]["n_removed"] == len(big) and found[3]["n_spans"] == 1 and not found[3]["kept"]
    assert found[4]["n_removed"] == 4_000_000 and bytes(found[4]["kept"]) == b"?" * 10


def test_packed_hashes():
    rng = random.Random(8)
    hashes = np.array(sorted({rng.getrandbits(48) for _ in range(300)}), np.uint64)
    twice, times = np.array([rng.random() < 0.5 for _ in hashes]), np.array([rng.choice([1, 2, 70_000]) for _ in hashes])
    got = suffixes._unpack_hashes(suffixes._pack_hashes(hashes, twice, times))
    assert (got[0] == hashes).all() and (got[1] == twice).all() and (got[2] == np.minimum(times, 65_535)).all()


def _with_crc(prefix: bytes, want: int) -> bytes:
    """``prefix`` and some letters, so that the crc32 is ``want``: a crc is linear over the bits that may flip."""
    import zlib

    base, bits = prefix + b"a" * 48, [(len(prefix) + i, 1 << b) for i in range(48) for b in (0, 1)]  # a, b, c and `
    rows = []
    for i, bit in bits:
        flipped = bytearray(base)
        flipped[i] ^= bit
        rows.append(zlib.crc32(bytes(flipped)) ^ zlib.crc32(base))
    goal, chosen, pivots = zlib.crc32(base) ^ want, 0, {}
    for k, value in enumerate(rows):
        made = 1 << k
        while value:
            top = value.bit_length()
            if top not in pivots:
                pivots[top] = (value, made)
                break
            value, made = value ^ pivots[top][0], made ^ pivots[top][1]
    while goal:
        value, made = pivots[goal.bit_length()]
        goal, chosen = goal ^ value, chosen ^ made
    out = bytearray(base)
    for k, (i, bit) in enumerate(bits):
        if chosen >> k & 1:
            out[i] ^= bit
    return bytes(out)


def test_texts_without_id_that_share_a_crc(spark):
    import zlib

    passage = "a passage of more than fifty characters that two documents have in common, word by word"
    long = passage + " and then something else"
    short = _with_crc(b"", zlib.crc32(long.encode())).decode()
    assert zlib.crc32(short.encode()) == zlib.crc32(long.encode())
    check(spark.createDataFrame([(1, passage), (None, long), (None, short)], "doc_id long, text string"))


def test_texts_that_share_a_mark(spark, monkeypatch):
    """The identity's first hash has two values here; the second finds the texts out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffixes, "_mark", lambda data: F.crc32(data) % 2)
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcd ") for _ in range(80)) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(passages) + rng.choice(["", "x" * 9]) + rng.choice(passages)) for _ in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_very_many_rows_of_one_text_and_no_id(spark):
    passage = "a passage of more than fifty characters that is here ten thousand times, and once before"
    rows = [(None, passage)] * 10_000 + [(None, None)] * 3000 + [(7, passage + " more")] * 200 + [(3, passage[5:] + " other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame).collect())
    assert got == brute(rows)
    worked, hot, _, _ = suffixes._plan(frame)
    assert worked.count() == 4 and hot.count() == 3


def test_an_anchor_in_very_many_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD_SEGMENTS", 3)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    check(spark.createDataFrame([(i, f"{rng.random()} " + passage[rng.randrange(30) :] + f" {rng.random()}") for i in range(40)], "doc_id long, text string"))


def test_blocks_of_a_run_are_coded_at_once():
    """Empty, single and large blocks come back as they were, and a key costs about as much in a block of its own: at 6 GB there are millions of those."""
    rng = np.random.default_rng(4)
    ids, marks = np.sort(rng.integers(-(1 << 62), 1 << 62, 50)), rng.integers(-(1 << 62), 1 << 62, 50)
    ids[-1] = suffixes._LAST
    took = {}
    for sizes in ([0, 1, 0, 40, 3, 0, 700, 0], [3000], [1] * 3000):
        sizes = np.array(sizes)
        keys = rng.integers(0, 3, (sizes.sum(), suffixes._KEY)).astype(np.uint8)
        keys[:, :40] = 7
        counts = rng.integers(1, 5, len(keys))
        doc, pos = rng.integers(0, 50, counts.sum()), rng.integers(0, 1 << 31, counts.sum())
        began = time.process_time()
        blocks = suffixes._encode(keys, counts, doc, pos, ids, marks, np.concatenate(([0], np.cumsum(sizes))))
        got = suffixes._decode([b for b in blocks if b])
        took[len(sizes)] = time.process_time() - began
        assert [bool(b) for b in blocks] == [n > 0 for n in sizes.tolist()]
        assert all(np.array_equal(a, b) for a, b in zip(got, (keys, counts, ids[doc], marks[doc], pos, sizes[sizes > 0])))
    assert took[3000] < 20 * took[1]
