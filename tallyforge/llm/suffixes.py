"""Exact repeated-passage removal by a distributed merge sort of sampled suffixes.

A byte goes if a 50-byte string over it also starts in a document with a smaller
doc_id. Every 50-byte window has an anchor: the 16-byte string in it with the
smallest hash, the leftmost of equals. Equal windows have equal anchors at equal
places, so only windows with the same anchor string need to meet. Neighbouring
windows mostly share their anchor; each run of windows with one anchor is a
*segment*, and its suffix (from the anchor on, then what lies before it) is
sorted.

Equal texts are collapsed first, by their digests: the one with the smallest doc_id
stands for all, since it starts every window of the others earlier.

Texts are dealt to runs. A first exchange of anchor hashes alone tells each run
which of its anchors another document may have; the rest cannot match and stay at
home. Runs then sort their suffixes, collapse equal ones, and exchange them front
coded: each entry is the length that it shares with the one before and the rest.
The windows of an anchor that many runs have are segments of their own and spread
over all tasks. Reduce tasks own the anchors of a hash range and merge the sorted
runs with a loser tree that knows how much every contender shares with the last
winner, so that shared prefixes are never compared again. In the merged order,
equal suffixes and equal anchors are neighbours: a segment that an earlier
document has whole goes, and where segments of one anchor differ their windows
are compared. Only byte ranges leave the tasks.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, beside, table

SPAN = 50
ANCHOR = 16
_RIGHT, _LEFT = SPAN, SPAN - ANCHOR
_KEY = _RIGHT + _LEFT + 2  # right part, left part, their lengths
_PIECE = 4 << 20
_RUN = 8 << 20
_POS_BITS = np.uint64(25)
_HASH_BITS = 48
#: Windows of differing segments that are compared at a time; those of one anchor stay together.
_WINDOWS = 200_000
#: An anchor that more runs than this have, or that stands in more segments, is not gathered in one task: its windows are dealt singly.
#: A run sends equal suffixes once, so up to here an anchor weighs little; dealt singly, its windows weigh up to 18 times as much.
CROWD = 1024
CROWD_SEGMENTS = 100_000
#: Bytes of text for each anchor range, where the session has fewer shuffle partitions than that.
_RANGE = 32 << 20
#: Parts that the copies of one text are dealt to.
_SALTS = 32
#: Rows that repeat doc_id and text more often are worked on once, and multiplied at the end.
HOT = 64
#: Slices of an anchor range that its task merges one after the other.
SLICES = 4
_LAST = (1 << 63) - 1  # null doc_ids come after all others


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as one number."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor position of each segment of the texts in ``data`` that begin at ``starts`` (its end included)."""
    words = _words(data)
    hashes = _mix(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + _mix(words[8:]))
    low = (hashes >> _POS_BITS << _POS_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN - ANCHOR + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - ANCHOR + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(anchor)]
    inside = np.arange(len(anchor)) + SPAN <= starts[owner + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return at[first], at[last], anchor[at[first]]


def keys_of(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Sort keys as rows of bytes: from the anchor to the segment's end, then from its start to the anchor, then both lengths."""
    right, left = last + SPAN - anchor, anchor - first
    out = np.zeros((len(first), _KEY), dtype=np.uint8)
    for begin, length, width, at in ((anchor, right, _RIGHT, 0), (first, left, _LEFT, _RIGHT)):
        steps = np.arange(width)
        place = np.minimum(begin[:, None] + steps, len(data) - 1)
        out[:, at : at + width] = np.where(steps < length[:, None], data[place], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def _shared(keys: np.ndarray) -> np.ndarray:
    """What each row shares with the row before."""
    if not len(keys):
        return np.zeros(0, np.uint8)
    differs = keys[1:] != keys[:-1]
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), _KEY)
    return np.concatenate(([0], same)).astype(np.uint8)


def _anchor_hash(keys: np.ndarray) -> np.ndarray:
    two = np.ascontiguousarray(keys[:, :ANCHOR]).view("<u8")
    return _mix(two[:, 0] * np.uint64(0x9E3779B97F4A7C15) + _mix(two[:, 1]))


def _encode(keys: np.ndarray, counts: np.ndarray, doc: np.ndarray, pos: np.ndarray, doc_ids: np.ndarray, marks: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Front-coded blocks of a run: distinct sorted keys, and for each its occurrences (document of the run, position).

    ``ends``: where blocks of keys end, 0 before; an empty block is empty bytes.
    All blocks are coded at once, since there may be far more of them than keys in one.
    """
    sizes = np.diff(ends)
    filled = np.flatnonzero(sizes)
    shared = _shared(keys)
    shared[ends[filled]] = 0
    rest = keys[np.arange(_KEY) >= shared[:, None]]
    block = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
    used, doc = np.unique(block * len(doc_ids) + doc, return_inverse=True)
    owner, used = np.divmod(used, max(1, len(doc_ids)))
    doc_ends = np.searchsorted(owner, np.arange(len(ends)))
    doc = doc - doc_ends[block]
    ids = doc_ids[used]
    steps = np.diff(ids, prepend=0)
    steps[doc_ends[filled]] = ids[doc_ends[filled]]
    rest_ends = np.concatenate(([0], np.cumsum(_KEY - shared.astype(np.int64))))[ends]
    times = np.concatenate(([0], np.cumsum(counts)))[ends]
    columns = [(shared, ends), (rest, rest_ends), (counts.astype("<u4"), ends), (doc.astype("<u4"), times), (pos.astype("<u4"), times), (steps.astype("<i8"), doc_ends), (marks[used].astype("<i8"), doc_ends)]
    pack, out = zstandard.ZstdCompressor(level=3).compress, [b""] * len(sizes)
    for p in filled.tolist():
        blobs = [c[at[p] : at[p + 1]].tobytes() for c, at in columns]
        out[p] = pack(struct.pack("<7Q", *map(len, blobs)) + b"".join(blobs))
    return out


def _decode(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of blocks one after the other: keys, counts, doc_id and mark and position of each occurrence, and how many keys each block has."""
    unpack, kinds = zstandard.ZstdDecompressor().decompress, ("u1", "u1", "<u4", "<u4", "<u4", "<i8", "<i8")
    columns: list[list[bytes]] = [[] for _ in kinds]
    for payload in payloads:
        data = unpack(payload)
        at = 56
        for column, size in zip(columns, struct.unpack_from("<7Q", data)):
            column.append(data[at : at + size])
            at += size
    sizes, times, docs = (np.array([len(b) // w for b in columns[k]], np.int64) for k, w in ((0, 1), (3, 4), (5, 8)))
    shared, rest, counts, doc, pos, steps, marks = (np.frombuffer(b"".join(c), kind) for c, kind in zip(columns, kinds))
    del columns
    shared, counts, pos = shared.astype(np.int64), counts.astype(np.int64), pos.astype(np.int64)
    first = np.cumsum(docs) - docs
    doc = doc.astype(np.int64) + np.repeat(first, times)
    ids = np.cumsum(steps)  # over all blocks; what those before add up to goes, whatever it wraps around to
    ids = ids - np.repeat(np.concatenate(([0], ids))[first], docs)
    # a block's first key shares nothing with the one before
    begins = np.concatenate(([0], np.cumsum(_KEY - shared)[:-1])) - shared
    keys, rows = np.empty((len(shared), _KEY), np.uint8), np.arange(len(shared))
    for c in range(_KEY):
        keys[:, c] = rest[begins[np.maximum.accumulate(np.where(shared <= c, rows, 0))] + c]
    return keys, counts, ids[doc], marks[doc], pos, sizes


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged order of sorted runs: run, entry, and what each shares with the one before it.

    A loser tree. ``have[r]`` is what the head of run r shares with the last
    winner. The head that shares more is the smaller; where two share as much,
    they are compared from there on, and the loser then shares with the winner
    what was found.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - len(runs))
    have, next_at = [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = have[a], have[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        u, v = x[p:], y[p:]
        if u == v:
            have[b] = _KEY
            return a, b
        differ = int.from_bytes(u, "big") ^ int.from_bytes(v, "big")
        found = _KEY - (differ.bit_length() + 7) // 8
        if u < v:
            have[b] = found
            return a, b
        have[a] = found
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if size > 1 else 0
    total = sum(map(len, runs))
    out_run, out_at, out_have = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.uint8)
    for k in range(total):
        at = next_at[w]
        out_run[k], out_at[k], out_have[k] = w, at, have[w]
        at += 1
        next_at[w] = at
        run = runs[w]
        if at < len(run):
            heads[w], have[w] = run[at], shared[w][at]
        else:
            heads[w] = None
        node = (w + size) >> 1
        while node:
            other = losers[node]
            x, y = heads[w], heads[other]
            # most games are decided by what is known already
            if y is not None and (x is None or have[other] > have[w]):
                losers[node], w = w, other
            elif x is not None and y is not None and have[other] == have[w]:
                w, losers[node] = play(w, other)
            node >>= 1
    return out_run, out_at, out_have


def _expand(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + count - 1 of each entry, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


def _earlier_windows(keys: np.ndarray, first: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of a segment, start and end in it, of the stretches whose windows another of these segments has from an earlier document."""
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    windows = left + right - SPAN + 1
    steps = np.arange(_LEFT + _RIGHT)
    source = np.where(steps < left[:, None], _RIGHT + steps, np.clip(steps - left[:, None], 0, _RIGHT - 1))
    whole = np.take_along_axis(keys, source, axis=1)
    owner = np.repeat(np.arange(len(keys)), windows)
    offset = _expand(np.zeros(len(keys), np.int64), windows)
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, SPAN, axis=1)[owner, offset]).view(f"S{SPAN}")[:, 0]
    same = np.unique(text, return_inverse=True)[1]
    least = np.full(same.max() + 1, _LAST, np.int64)
    np.minimum.at(least, same, first[owner])
    edge = np.flatnonzero(least[same] < first[owner])
    apart = (np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]])
    some = [True] if len(edge) else []
    starts, stops = edge[np.concatenate((some, apart)).astype(bool)], edge[np.concatenate((apart, some)).astype(bool)]
    return names[owner[starts]], offset[starts], offset[stops] + SPAN


def resolve(payloads: list[bytes]) -> pd.DataFrame | None:
    """Byte ranges that go, from all runs of one set of anchors."""
    keys, counts, docs, marks, pos, sizes = _decode(payloads)
    begins = np.cumsum(counts) - counts
    hashes = _anchor_hash(keys)
    names, group = np.unique(hashes, return_inverse=True)
    low, high = np.full(len(names), _LAST, np.int64), np.full(len(names), -(1 << 63), np.int64)
    np.minimum.at(low, group, np.minimum.reduceat(docs, begins))
    np.maximum.at(high, group, np.maximum.reduceat(docs, begins))
    keep = (low < high)[group]
    if not keep.any():
        return None
    occurs, sizes = np.repeat(keep, counts), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
    keys, counts, docs, marks, pos = keys[keep], counts[keep], docs[occurs], marks[occurs], pos[occurs]
    del hashes, group, keep, occurs, begins
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    shared = _shared(keys)
    shared[starts] = 0
    heads, have = np.ascontiguousarray(keys).view(f"V{_KEY}")[:, 0].tolist(), shared.tolist()
    spans = [slice(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist())]
    run, at, have = merge_runs([heads[s] for s in spans], [have[s] for s in spans])
    del heads

    # everything below is in merged order
    entry = starts[run] + at
    order = _expand((np.cumsum(counts) - counts)[entry], counts[entry])
    docs, marks, pos, counts = docs[order], marks[order], pos[order], counts[entry]
    variant_new, anchor_new = have < _KEY, have < ANCHOR
    variant = np.cumsum(variant_new) - 1
    heads = np.flatnonzero(variant_new)
    keys = keys[entry[heads]]
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    windows = left + right - SPAN + 1
    of = np.repeat(variant, counts)
    first = np.full(len(heads), _LAST, np.int64)
    np.minimum.at(first, of, docs)
    later = docs > first[of]
    frames = [(docs[later], marks[later], pos[later], pos[later] + windows[of[later]] - 1 + SPAN)]

    anchors = np.cumsum(anchor_new[heads]) - 1
    mixed = np.flatnonzero(np.bincount(anchors)[anchors] > 1)  # variants that share their anchor with others
    if len(mixed):
        groups = np.flatnonzero(np.diff(anchors[mixed], prepend=-1))
        before = (np.cumsum(windows[mixed]) - windows[mixed])[groups]
        cuts = groups[np.flatnonzero(np.diff(before // _WINDOWS, prepend=-1))]
        found = [_earlier_windows(keys[m], first[m], m) for m in np.split(mixed, cuts[1:])]
        ranges = pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate("vab")})
        own = ~later & np.isin(of, ranges["v"].to_numpy())
        met = pd.DataFrame({"v": of[own], "doc": docs[own], "mark": marks[own], "pos": pos[own]}).merge(ranges, on="v")
        frames.append((met["doc"].to_numpy(), met["mark"].to_numpy(), (met["pos"] + met["a"]).to_numpy(), (met["pos"] + met["b"]).to_numpy()))
    doc, mark, start, end = (np.concatenate([f[c] for f in frames]) for c in range(4))
    return pd.DataFrame({"doc": doc, "mark": mark, "start": start, "end": end}) if len(doc) else None


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in bounded buffers: bytes, piece starts, and for each piece its text's number and place in it. Long texts overlap by a window less one."""
    pending: list[tuple[int, int, bytes]] = []
    size = 0

    def buffer() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate(([0], np.cumsum([len(p[2]) for p in pending])))
        return np.frombuffer(b"".join(p[2] for p in pending), np.uint8), starts, np.array([p[0] for p in pending]), np.array([p[1] for p in pending])

    for k, text in enumerate(texts):
        for offset in range(0, len(text) - SPAN + 1, _PIECE):
            piece = text[offset : offset + _PIECE + SPAN - 1]
            pending.append((k, offset, piece))
            size += len(piece)
            if size >= _PIECE:
                yield buffer()
                pending.clear()
                size = 0
    if pending:
        yield buffer()


def _anchor_hashes(data: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    words = _words(data)
    chosen = _mix(words[anchor] * np.uint64(0x9E3779B97F4A7C15) + _mix(words[anchor + 8]))
    # anchors have the smallest of many hashes, so these are spread anew
    return _mix(chosen * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _HASH_BITS)


def _distinct_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes of some texts, which of them two texts have, and in how many segments they stand."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for data, starts, number, _ in _pieces(texts):
        first, _, anchor = segments(data, starts)
        hashes.append(_anchor_hashes(data, anchor))
        owners.append(number[np.searchsorted(starts, first, side="right") - 1])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[begins], np.minimum.reduceat(owner, begins) != np.maximum.reduceat(owner, begins), np.diff(np.append(begins, len(h)))


def _pack_hashes(hashes: np.ndarray, twice: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, so that the high ones compress away, and their segments up to 65,535."""
    planes = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _HASH_BITS // 8]
    counts = np.minimum(times, 65_535).astype("<u2")
    return zstandard.compress(struct.pack("<Q", len(hashes)) + np.ascontiguousarray(planes.T).tobytes() + counts.tobytes() + np.packbits(twice).tobytes(), 3)


def _unpack_hashes(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(payload)
    (n,) = struct.unpack_from("<Q", data)
    width = _HASH_BITS // 8
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, n * width, 8).reshape(width, n).T
    times = np.frombuffer(data, "<u2", n, 8 + n * width).astype(np.int64)
    twice = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + n * (width + 2)), count=n).astype(bool)
    return np.cumsum(planes.view("<u8")[:, 0], dtype=np.uint64), twice, times


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash; sorted hashes have sorted ranges, so that differences within a range stay small."""
    return (hashes >> np.uint64(_HASH_BITS - 24)) * np.uint64(parts) >> np.uint64(24)


def _run_of(runs: int) -> F.Column:
    return F.pmod(F.xxhash64("doc", "mark"), F.lit(runs)).cast("int")


def equal_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, mark) of the first row of each text, and (doc, mark, start, end), the whole text, of rows that repeat an earlier document's text."""
    digests = rows.where(F.octet_length("data") >= SPAN).select("doc", "mark", F.octet_length("data").cast("long").alias("end"), F.unhex(F.sha2("data", 256)).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.any_value("mark").alias("mark"), F.count("*").alias("times"))
    # a text with very many copies spreads over several tasks
    repeated = first.where("times > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)).cast("int"))
    copies = salted.join(repeated, ["digest", "salt"]).where("doc > first").select("doc", "mark", F.lit(0).cast("long").alias("start"), "end")
    return first.select(F.col("first").alias("doc"), "mark"), copies


def _mark(data: F.Column) -> F.Column:
    """What tells texts of one doc_id apart, null ones being one; ``_plan`` mends the cases where it does not."""
    return F.xxhash64(data)


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int, int]:
    """The rows by run, (doc, mark, times) of rows that are there very often, the number of runs, and of anchor ranges.

    Rows with one doc and mark have one text, for sure: where two texts share
    them, as a second hash shows, all texts with that mark get one of their
    digest. Of rows that repeat doc and text more than ``HOT`` times one is left.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), _mark(data).alias("mark"), data.alias("data"))
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts, runs = max(tasks, -(-size // _RANGE)), max(tasks, -(-size // _RUN))
    counted = rows.select("doc", "mark", F.crc32("data").alias("other")).groupBy("doc", "mark").agg(F.count("*").alias("times"), F.min("other").alias("low"), F.max("other").alias("high"))
    odd = scratch.save(counted.where((F.col("times") > HOT) | (F.col("low") != F.col("high"))), "odd")
    hot = None
    if not odd.isEmpty():
        double = odd.where("low <> high").select("mark", F.lit(True).alias("double")).distinct()
        rows = rows.join(beside(double), "mark", "left").withColumn("mark", F.when(F.col("double"), F.xxhash64(F.sha2("data", 256))).otherwise(F.col("mark"))).drop("double")
        hot = beside(odd.where("low = high").select("doc", "mark", "times"))
        single = rows.join(hot, ["doc", "mark"], "left_semi").groupBy("doc", "mark").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("data").alias("data"))
        rows = rows.join(hot, ["doc", "mark"], "left_anti").unionByName(single)
    return rows.withColumn("run", _run_of(runs)), hot, runs, parts


def _first_texts(batch: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
    """The rows of a run that are the first with their text, each once."""
    known = pd.MultiIndex.from_frame(first[["doc", "mark"]])
    return batch[pd.MultiIndex.from_frame(batch[["doc", "mark"]]).isin(known)].drop_duplicates(["doc", "mark"])


def shared_anchors(rows: DataFrame, first: DataFrame, parts: int, crowd: int) -> DataFrame:
    """(run, part, bits): which of a run's sorted anchor hashes of that range more than one document has, and then which are crowded: more than ``crowd`` runs have them, or they stand in more than ``CROWD_SEGMENTS`` segments."""

    def list_anchors(batch: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        batch = _first_texts(batch, first)
        hashes, twice, times = _distinct_anchors([bytes(x) for x in batch["data"]])
        ends = np.searchsorted(_range_of(hashes, parts), np.arange(parts + 1, dtype=np.uint64))
        out = [(int(batch["run"].iloc[0]), p, _pack_hashes(hashes[a:b], twice[a:b], times[a:b])) for p, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        return pd.DataFrame(out, columns=["run", "part", "payload"])

    def find_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for run, part, payload in zip(batch["run"], batch["part"], batch["payload"]):
                held.setdefault(part, []).append((run, *_unpack_hashes(bytes(payload))))
        for part, lists in held.items():
            names, counts = np.unique(np.concatenate([h for _, h, _, _ in lists]), return_counts=True)
            total = np.zeros(len(names), np.int64)
            for _, hashes, _, times in lists:
                total[np.searchsorted(names, hashes)] += times
            crowded = (counts > crowd) | (total > CROWD_SEGMENTS)
            out = []
            for run, hashes, twice, _ in lists:
                at = np.searchsorted(names, hashes)
                out.append((run, part, np.packbits(np.concatenate((twice | (counts[at] > 1), crowded[at]))).tobytes()))
            yield pd.DataFrame(out, columns=["run", "part", "bits"])

    listed = rows.groupBy("run").cogroup(first.groupBy("run")).applyInPandas(list_anchors, "run int, part int, payload binary")
    return listed.repartitionById(parts, F.col("part")).mapInPandas(find_shared, "run int, part int, bits binary")


def _key_hash(keys: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(keys), -(-_KEY // 8) * 8), np.uint8)
    padded[:, :_KEY] = keys
    out = np.zeros(len(keys), np.uint64)
    for word in padded.view("<u8").T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out >> np.uint64(64 - _HASH_BITS)


def repeated_ranges(rows: DataFrame, first: DataFrame, parts: int, crowd: int = CROWD, ranges_per_frame: int = 100_000) -> DataFrame:
    """(doc, mark, start, end): byte ranges of the ``first`` rows of each text whose windows start in a document with a smaller doc_id."""

    def sort_suffixes(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"part": [], "slice": [], "payload": []})
        batch = _first_texts(batch, answers[answers["part"] < 0])
        answers = answers[answers["part"] >= 0]
        if batch.empty or answers.empty:
            return empty
        texts = [bytes(x) for x in batch["data"]]
        hashes, _, _ = _distinct_anchors(texts)
        ends = np.searchsorted(_range_of(hashes, parts), np.arange(parts + 1, dtype=np.uint64))
        shared, crowded = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        for p, bits in zip(answers["part"], answers["bits"]):
            own = slice(ends[p], ends[p + 1])
            n = ends[p + 1] - ends[p]
            both = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), count=2 * n).astype(bool)
            shared[own], crowded[own] = both[:n], both[n:]
        crowded = crowded[shared]
        shared = hashes[shared]
        if not len(shared):
            return empty
        held = []
        for data, starts, number, offset in _pieces(texts):
            first, last, anchor = segments(data, starts)
            own = _anchor_hashes(data, anchor)
            at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
            keep = shared[at] == own
            first, last, anchor, own, alone = first[keep], last[keep], anchor[keep], own[keep], crowded[at[keep]]
            # the windows of a crowded anchor are segments of their own, dealt by all that they hold
            times = np.where(alone, last - first + 1, 1)
            anchor, own, split = np.repeat(anchor, times), np.repeat(own, times), np.repeat(alone, times)
            first, last = _expand(first, times), np.repeat(last, times)
            last = np.where(split, first, last)
            piece = np.searchsorted(starts, first, side="right") - 1
            keys = keys_of(data, first, last, anchor)
            range_ = _range_of(np.where(split, _key_hash(keys), own), parts * SLICES)
            held.append((keys, number[piece], first + (offset - starts[:-1])[piece], range_))
        keys, doc, pos, part = (np.concatenate([h[c] for h in held]) for c in range(4))
        order = np.argsort(keys.view(f"S{_KEY}")[:, 0], kind="stable")
        keys, doc, pos, part = keys[order], doc[order], pos[order], part[order]
        begins = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
        counts, distinct, part = np.diff(np.append(begins, len(keys))), keys[begins], part[begins]
        by_part = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[by_part], np.arange(parts * SLICES + 1))
        at = _expand(begins[by_part], counts[by_part])
        distinct, counts, pos = distinct[by_part], counts[by_part], pos[at]
        del keys
        ids, marks = batch["doc"].to_numpy(np.int64), batch["mark"].to_numpy(np.int64)
        rank = np.argsort(ids, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        blocks = _encode(distinct, counts, place[doc[at]], pos, ids[rank], marks[rank], ends)
        out = [(p // SLICES, p, block) for p, block in enumerate(blocks) if block]
        return pd.DataFrame(out, columns=["part", "slice", "payload"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks come sorted by slice."""
        blocks = ((k, bytes(payload)) for batch in batches for k, payload in zip(batch["slice"], batch["payload"]))
        for _, own in itertools.groupby(blocks, key=lambda x: x[0]):
            if (ranges := resolve([payload for _, payload in own])) is not None:
                for at in range(0, len(ranges), ranges_per_frame):
                    yield ranges.iloc[at : at + ranges_per_frame]

    answers = shared_anchors(rows, first, parts, crowd).select("run", "part", "bits", F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("mark"))
    both = answers.union(first.select("run", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("bits"), "doc", "mark"))
    suffixes = rows.groupBy("run").cogroup(both.groupBy("run")).applyInPandas(sort_suffixes, "part int, slice int, payload binary")
    return suffixes.repartitionById(parts, F.col("part")).sortWithinPartitions("slice").mapInPandas(merge, "doc long, mark long, start long, end long")


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) and ``spans`` of each row of ``docs``.

    Null and short texts lose nothing. Rows with one doc_id do not count against
    each other, repeated rows lose alike, and null doc_ids come after all
    others. Extra columns are ignored; an empty table gives an empty result.

    Texts are dealt to runs of some megabytes by one shuffle, which all three
    passes over them share.
    """
    rows, hot, runs, parts = _plan(docs)
    told_apart = [] if hot is None else ["doc", "mark"]
    first, copies = equal_texts(rows)
    ranges = repeated_ranges(rows, first.withColumn("run", _run_of(runs)), parts, crowd).union(copies).withColumn("run", _run_of(runs))

    def apply(batch: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        by_doc = {k: (g["start"].to_numpy(), g["end"].to_numpy()) for k, g in ranges.groupby(["doc", "mark"])}
        out = []
        for doc_id, doc, mark, text in zip(batch["doc_id"].astype("Int64"), batch["doc"], batch["mark"], batch["data"]):
            text = bytes(text)
            found = by_doc.get((doc, mark))
            if found is None:
                out.append((doc_id, len(text), 0, 0, text, [], doc, mark))
                continue
            edges = np.zeros(len(text) + 1, np.int64)
            np.add.at(edges, found[0], 1)
            np.add.at(edges, found[1], -1)
            gone = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
            out.append((doc_id, len(text), int(gone.sum()), len(spans), np.frombuffer(text, np.uint8)[~gone].tobytes(), spans, doc, mark))
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        return pd.DataFrame(out, columns=[*columns, "doc", "mark"]).astype({"doc_id": "Int64"})[columns + told_apart]

    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    if hot is None:
        return rows.groupBy("run").cogroup(ranges.groupBy("run")).applyInPandas(apply, kept)
    told = rows.groupBy("run").cogroup(ranges.groupBy("run")).applyInPandas(apply, f"{kept}, doc long, mark long")
    again = told.join(hot, ["doc", "mark"], "left").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1)).cast("int"))))
    return again.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffixes": op5_suffixes}
ORACLES: dict[str, str] = {}
