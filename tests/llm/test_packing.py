import zlib

import numpy as np
import pytest

from tallyforge.llm import packing


def check(df):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    rows = df.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), tuple(model.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in rows)
    pieces = packing.pack(df).toPandas()
    at = {}
    for seq, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]]
        total = int(part["length"].sum())
        assert total == packing.WINDOW or total & (total - 1) == 0
    pool = {}
    for doc, ids in want:
        pool.setdefault((doc, len(ids)), []).append(np.array(ids, "<u4"))
    for _, p in pieces.iterrows():
        key = (str(None if p["doc_id"] is None or p["doc_id"] != p["doc_id"] else int(p["doc_id"])).replace("<NA>", "None"), int(p["doc_tokens"]))
        s, n = int(p["start"]), int(p["length"])
        assert any(zlib.crc32(ids[s : s + n].tobytes()) == p["ids_crc32"] for ids in pool[key])
        at[key] = at.get(key, 0) + n
    assert at == {k: k[1] * len(v) for k, v in pool.items()}


def test_round_trip(odd, documents):
    check(odd)
    check(documents)
    assert packing.pack(odd.limit(0)).count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(16)
    for k in range(300):
        size = int(rng.integers(1, 16))
        counts = packer.count.copy()

        def squares(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16].astype(int) ** 2).sum())

        options = [0, *[h for h in range(1, 17 - size) if counts[h]]]
        assert squares(packer.level_for(size)) == min(map(squares, options))
        packer.place((k, 0, np.zeros(size, np.uint32), size))
        assert [len(x) for x in packer.open[1:16]] == packer.count[1:16].tolist()


def test_words_equal_whole_texts():
    words = packing.WordTokenizer(packing.default_vocabulary())
    for text in ["don't they're we'll x's", "\u0130stanbul \u03a3\u0391\u03a3 \u1e9e stra\u00dfe", "a\u0301 e\u0301b \u0301x", "foo!! bar... (x)", "\uff11\uff12 abc123 ab-cd", "\u65e5\u672c\u8a9e emoji\U0001f600 x\U0001f600", "\u00a0nbsp em\u2003space \x1cfs", "<|endoftext|> a<|endoftext|>b", "", " \n\t "]:
        assert next(words.batch([text])).tolist() == words.full.encode(text, add_special_tokens=False).ids + [1]


def test_other_vocabularies_and_long_words(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, model = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert not other.by_words and packing.WordTokenizer(packing.default_vocabulary()).by_words
    for text in ("Two  words\n and\tmore", "", None, "don't"):
        assert next(other.batch([text])).tolist() == model.encode(text or "", add_special_tokens=False).ids + [1]
    words = packing.WordTokenizer(packing.default_vocabulary())
    long = "\u65e5\u672c\u8a9e" * 200_000 + " " + "x" * 100_000 + " end"
    assert next(words.batch([long])).tolist() == words.full.encode(long, add_special_tokens=False).ids + [1]
    assert max(map(len, words)) <= packing.LONGEST_CACHED
    monkeypatch.setattr(packing, "MAX_CACHED_BYTES", 5_000)
    for k in range(300):
        list(words.batch([f"word{k} andmore{k}"]))
        assert words.held <= 5_000
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=1000)


@pytest.mark.parametrize("n", [1, 3, 62, 250, 2000, 8000])
def test_what_a_partition_end_moves(n):
    rng = np.random.default_rng(n)
    window, packer, placed, moved = 2048, packing.SumOfSquares(2048), 0, 0
    sizes = np.clip(rng.lognormal(5.5, 1.0, n), 1, 20_000).astype(int)
    seen, cut = {}, 0
    for k, size in enumerate(sizes):
        ids = np.full(size, k, np.uint32)
        for start in range(0, size, window):
            full = packer.place((k, start, ids[start : start + window], int(size)))
            if full:
                placed += sum(len(p[2]) for p in full)
                seen.update({(p[0], p[1] + i): None for p in full for i in range(len(p[2]))})
    still = sum(len(p[2]) for level in packer.open for pieces in level for p in pieces)
    opened = sum(map(len, packer.open))
    pieces_before = sum(len(pieces) for level in packer.open for pieces in level)
    pieces_after = 0
    for pieces, stay in packer.rest():
        total = sum(len(p[2]) for p in pieces)
        assert total == window or (total & (total - 1) == 0 and stay == 0)
        pieces_after += len(pieces)
        moved += sum(len(p[2]) for p in pieces[stay:])
        for doc, start, ids, _ in pieces:
            for i in range(len(ids)):
                assert (doc, start + i) not in seen
                seen[doc, start + i] = None
    assert len(seen) == sizes.sum() and placed + still == sizes.sum()
    assert pieces_after - pieces_before <= still // window + 11  # a cut a window at most, and those of the last powers of two
    print(f"{n} documents: {moved / sizes.sum():.3f} of the tokens moved, {opened} windows were open")
    assert moved <= still and (n < 2000 or moved / sizes.sum() < 0.12)
