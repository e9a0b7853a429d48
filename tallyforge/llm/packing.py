"""Packing token sequences into fixed windows by the sum-of-squares rule.

Documents longer than a window give full windows; what is left over is placed
online. Among the fill levels that still have room (and an empty window), the
rule takes the one after which the sum over levels of the squared number of
partially filled windows is smallest. That number is held in an array by level.

When a partition ends some windows are still open. As many of the fullest as
their tokens can fill stay as the rule made them; the pieces of the others move
into their room, whole where they fit and cut once to close a window, and the
last tokens go into powers of two, which need no padding. Such pieces are marked
``moved``. The fewer documents a partition has, the more of them move: windows
are open at up to every level, so a partition should hold many thousands.

Every task packs its own partition, holds the open windows only, and numbers
its sequences within its partition's range, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import table

WINDOW = 2048
SEPARATOR = 1
#: Words that are remembered: the longest, in characters, and the bytes of all of them together.
LONGEST_CACHED = 64
MAX_CACHED_BYTES = 48 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"
#: What a vocabulary file must say for its texts to be tokenized word by word.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write the bytes that do not print as the characters from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer(dict):
    """Token ids by word, as little-endian bytes.

    Where the vocabulary file's rules are those of ``_BY_WORDS``, characters are
    never joined across white space, so a text's ids are those of its words. They
    also part letters from what follows and lower-case them; a word of plain Latin
    letters with punctuation behind is put together from both, and any other word
    goes through the whole tokenizer. Short words are remembered. With other
    rules every text goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.bytes_as = _byte_letters()
        self.held = 0
        said = json.loads(self.full.to_str())
        special = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in said["added_tokens"])
        self.by_words = special and said["model"]["type"] == "BPE" and all(said.get(k) == v for k, v in _BY_WORDS.items())

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?#$%&*|()-")
        if len(word) <= LONGEST_CACHED and core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
            lower = core.lower()
            if core != word or lower != core:
                found = self[lower] + (self[word[len(core) :]] if core != word else b"")
            else:
                said = core if core.isascii() else core.encode().decode("latin-1").translate(self.bytes_as)
                found = self._packed([t.id for t in self.model.tokenize(said)])
        else:
            found = self._packed(self.full.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST_CACHED:
            self.held += 200 + 4 * len(word) + len(found)
            if self.held > MAX_CACHED_BYTES:
                self.clear()
                self.held = 0
            self[word] = found
        return found

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        end = self._packed([SEPARATOR])
        for text in texts:
            if self.by_words:
                words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
                ids = b"".join(map(self.__getitem__, words))
            else:
                ids = self._packed(self.full.encode(text or "", add_special_tokens=False).ids)
            yield np.frombuffer(ids + end, dtype="<u4")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a document of this text, with the separator."""
    path = vocabulary or default_vocabulary()

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in tokenizer(path).batch(texts.tolist())], dtype="int64")

    return F.pandas_udf(count, "long")(text)


class SumOfSquares:
    """Open windows by fill level. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        levels = np.flatnonzero(self.count[: self.window - size + 1])
        after = levels + size
        change = np.where(after < self.window, 2 * (self.count[after] + 1), 1) - 2 * self.count[levels]
        best, least = 0, 2 * self.count[size] + 1
        if len(levels):
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            best = int(levels[k]) if change[k] <= least else 0
        return best

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece in; the window, where it is full now."""
        size = len(piece[2])
        level = self.level_for(size) if size < self.window else 0
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == self.window:
            return pieces
        self.open[level].append(pieces)
        self.count[level] += 1
        return None

    def rest(self) -> Iterator[tuple[list[tuple], int]]:
        """What is still open: windows and the number of their pieces that stay as they were placed.

        The fullest windows are filled up with the pieces of the others. Each
        takes the largest pieces that fit, then the beginning of one that does
        not, so at most one piece is cut for each.
        """
        windows = [pieces for level in reversed(self.open) for pieces in level]
        sizes = [sum(len(p[2]) for p in pieces) for pieces in windows]
        full = sum(sizes) // self.window
        loose = sorted((p for pieces in windows[full:] for p in pieces), key=lambda p: len(p[2]))
        lengths = [len(p[2]) for p in loose]

        def take(room: int) -> Iterator[tuple]:
            while room:
                at = bisect.bisect_right(lengths, room) - 1
                if at >= 0:
                    room -= lengths.pop(at)
                    yield loose.pop(at)
                    continue
                doc, start, ids, total = loose.pop(0)
                lengths.pop(0)
                yield doc, start, ids[:room], total
                at = bisect.bisect_left(lengths, len(ids) - room)
                loose.insert(at, (doc, start + room, ids[room:], total))
                lengths.insert(at, len(ids) - room)
                room = 0

        for pieces, size in zip(windows[:full], sizes):
            yield [*pieces, *take(self.window - size)], len(pieces)
        left = sum(lengths)
        while left:
            room = 1 << (left.bit_length() - 1)
            yield list(take(room)), 0
            left -= room


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document's ids (its text's, then the separator id).

    A null or empty text is the separator alone. Repeated rows and null doc_ids
    are documents of their own. Cuts fall anywhere, every id lies in exactly one
    piece. Sequences are full or, the last ones of a partition, powers of two
    long; ``moved`` tells pieces that a partition's end took out of the window
    where the rule had put them. Any vocabulary file will do (see
    ``WordTokenizer``); ``window`` is a power of two. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, windows = tokenizer(path), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def close(pieces: list[tuple], placed: int) -> None:
            nonlocal sequence
            offset = 0
            for k, (doc, start, ids, total) in enumerate(pieces):
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, k >= placed))
                offset += len(ids)
            sequence += 1

        def frame() -> pd.DataFrame:
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = dict(x.split() for x in PIECES.split(", "))
            out = pd.DataFrame({k: pd.array(v, dtype="Int64" if kinds[k] == "long" else "boolean") for k, v in zip(kinds, columns)})
            rows.clear()
            return out

        for batch in batches:
            ids_of = batch["doc_id"].astype("Int64")
            for doc, ids in zip(ids_of, tokens.batch(batch["text"].tolist())):
                for start in range(0, len(ids), window):
                    full = windows.place((doc, start, ids[start : start + window], len(ids)))
                    if full:
                        close(full, len(full))
                if len(rows) > 50_000:
                    yield frame()
        for pieces, placed in windows.rest():
            close(pieces, placed)
            if len(rows) > 50_000:
                yield frame()
        yield frame()

    return docs.select("doc_id", "text").mapInPandas(fill, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
