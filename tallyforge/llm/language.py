"""Language identification with hyperdimensional letter n-gram profiles.

Each letter has a fixed random vector of +1 and -1. The vector of an n-gram
binds (multiplies) its letters' vectors, each rotated by its place; a text is
the bundle (sum) of its n-grams' vectors, and so is a language's prototype. A
text gets the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import table

DIM = 512
#: For keeping or dropping texts: a text that shares no n-gram with a prototype has a cosine of 0 give or take 1/sqrt(dim).
WIDE_DIM = 65_536
_DEVIATIONS = 4
#: N-grams whose products with the prototypes a task remembers.
_KNOWN = 1 << 18
ORDER = 3
MAX_TRAINING = 50_000
UNKNOWN = "und"
_WIDTH = 21  # bits that a code point needs


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1 << 8)
def _letter_vector(code: int, dim: int) -> np.ndarray:
    return (np.random.default_rng([code, dim]).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter n-grams of the lower-cased text and their counts; a run of other characters is one boundary."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([0], np.where(is_letter, codes, 0), [0])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    packed = codes[: len(codes) - ORDER + 1].copy()
    for k in range(1, ORDER):
        packed = (packed << _WIDTH) | codes[k : len(codes) - ORDER + 1 + k]
    return np.unique(packed, return_counts=True)


def gram_vectors(packed: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A bound vector for each packed n-gram."""
    out = np.ones((len(packed), dim), dtype=np.int8)
    for k in range(ORDER):
        codes, at = np.unique((packed >> (_WIDTH * (ORDER - 1 - k))) & ((1 << _WIDTH) - 1), return_inverse=True)
        base = np.stack([_letter_vector(int(c), dim) for c in codes]) if len(codes) else np.ones((0, dim), np.int8)
        out *= np.roll(base, ORDER - 1 - k, axis=1)[at]
    return out


def _bundles(texts: list[str | None], dim: int) -> Iterator[np.ndarray | None]:
    """The bundle of each text, None for a text without letters; n-gram vectors are made once for some texts together."""
    for at in range(0, len(texts), 256):
        counted = [gram_counts(t) for t in texts[at : at + 256]]
        grams = np.unique(np.concatenate([g for g, _ in counted]))
        vectors = gram_vectors(grams, dim).astype(np.float32)
        for g, n in counted:
            yield n.astype(np.float32) @ vectors[np.searchsorted(grams, g)] if len(g) else None


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _learning_rows(docs: DataFrame, max_training: int) -> DataFrame:
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = rows.count()
    if n > max_training:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(max_training / n * (1 << 30)))
    return rows


def train_prototypes(docs: DataFrame, dim: int = DIM, max_training: int = MAX_TRAINING) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from rows with text and lang that are not held out.

    At most about ``max_training`` rows are used, drawn by a hash of doc_id; a
    smaller table is used whole. Each text counts with its unit bundle. What
    reaches the driver is one vector per language.
    """
    rows = _learning_rows(docs, max_training)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, bundle in zip(batch["lang"], _bundles(batch["text"].tolist(), dim)):
                if bundle is not None:
                    total[lang] = total.get(lang, 0) + bundle / max(np.linalg.norm(bundle), 1e-9)
        for lang, bundle in total.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(dim), "value": bundle.astype(np.float64)})

    sums = rows.select("lang", "text").mapInPandas(add_up, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in sums.collect():  # dim rows per language
        out.setdefault(row["lang"], np.zeros(dim))[row["at"]] = row["value"]
    return {lang: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for lang, v in sorted(out.items())}


def predict_language(text: F.Column, prototypes: dict[str, np.ndarray], dim: int = DIM) -> F.Column:
    """struct(lang, score): the nearest prototype and its cosine, cut to 0..1; ``und`` and 0 for a null text or one without letters.

    Ties go to the language that sorts first. Without prototypes all texts are ``und``.
    """
    langs = list(prototypes)
    matrix = np.stack([prototypes[k] for k in langs]) if langs else np.zeros((0, dim), np.float32)

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for bundle in _bundles(texts.tolist(), dim):
                if bundle is None or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = matrix @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pd.DataFrame({"lang": names, "score": scores})

    return nearest(text)


def identify(docs: DataFrame, dim: int = DIM, max_training: int = MAX_TRAINING) -> DataFrame:
    """``docs`` with a column ``found`` (struct of lang and score), its prototypes learnt from ``docs`` itself.

    Null doc_ids are neither held out nor learnt from. Repeated rows each count.
    An empty table gives an empty result. A column named ``found`` is replaced.
    """
    return docs.withColumn("found", predict_language(F.col("text"), train_prototypes(docs, dim, max_training), dim))


def _dots(matrix: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The dot product of each n-gram's vector with each row of ``matrix``; some n-grams at a time, as wide vectors are large."""
    parts = [gram_vectors(packed[at : at + 64], matrix.shape[1]).astype(np.float32) @ matrix.T for at in range(0, len(packed), 64)]
    return np.concatenate(parts) if parts else np.zeros((0, len(matrix)), np.float32)


def train_wide(docs: DataFrame, dim: int = WIDE_DIM, max_training: int = MAX_TRAINING) -> dict[str, np.ndarray]:
    """Prototypes as of ``train_prototypes``, in many dimensions.

    N-grams are counted first and each is made a vector once, and a text's length
    is taken from its counts, as the vectors are all but orthogonal.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights: dict[str, dict[int, float]] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                g, n = gram_counts(text)
                if len(g):
                    held = weights.setdefault(lang, {})
                    for gram, weight in zip(g.tolist(), (n / np.linalg.norm(n)).tolist()):
                        held[gram] = held.get(gram, 0.0) + weight
            for lang, held in weights.items():
                yield pd.DataFrame({"lang": lang, "gram": list(held), "weight": list(held.values())})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                grams, n = rows["gram"].to_numpy(), rows["weight"].to_numpy(np.float32)
                for at in range(0, len(grams), 64):
                    total[lang] = total.get(lang, 0) + n[at : at + 64] @ gram_vectors(grams[at : at + 64], dim).astype(np.float32)
        for lang, bundle in total.items():
            yield pd.DataFrame({"lang": [lang], "bundle": [bundle.astype(np.float64).tobytes()]})

    rows = _learning_rows(docs, max_training).select("lang", "text")
    weights = rows.mapInPandas(weigh, "lang string, gram long, weight double").groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    out: dict[str, np.ndarray] = {}
    for row in weights.repartition(6).mapInPandas(add_up, "lang string, bundle binary").collect():  # six vectors per language at most
        out[row["lang"]] = out.get(row["lang"], 0) + np.frombuffer(row["bundle"])
    return {lang: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for lang, v in sorted(out.items())}


def best_score(text: F.Column, prototypes: dict[str, np.ndarray]) -> F.Column:
    """The highest cosine with a prototype, as ``predict_language`` has it; null for a text without letters or where there are no prototypes."""
    matrix = np.stack(list(prototypes.values())) if prototypes else np.zeros((0, 1), np.float32)

    @F.pandas_udf("double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, dots = np.empty(0, np.int64), np.zeros((0, len(matrix)), np.float32)
        for texts in batches:
            scores: list[float | None] = []
            for at in range(0, len(texts), 64):
                counted = [gram_counts(t) for t in texts.iloc[at : at + 64]]
                grams = np.unique(np.concatenate([g for g, _ in counted]))
                new = np.setdiff1d(grams, known, assume_unique=True)
                if len(known) + len(new) > _KNOWN:
                    known, dots, new = known[:0], dots[:0], grams
                if len(new) and len(matrix):
                    order = np.argsort(np.concatenate((known, new)), kind="stable")
                    known, dots = np.concatenate((known, new))[order], np.concatenate((dots, _dots(matrix, new)))[order]
                for g, n in counted:
                    if not len(g) or not len(matrix):
                        scores.append(None)
                        continue
                    cosines = n @ dots[np.searchsorted(known, g)] / (np.linalg.norm(n) * np.sqrt(matrix.shape[1]))
                    scores.append(min(1.0, float(cosines.max())))
            yield pd.Series(scores, dtype="float64")

    return best(text)


def keep_identified(docs: DataFrame, min_score: float | None = None, dim: int = WIDE_DIM) -> DataFrame:
    """Rows whose language is found; a text without letters or unlike every prototype goes.

    ``min_score``: the least cosine; unless given, four deviations of what texts
    without a known n-gram have by chance in ``dim`` dimensions.
    """
    least = _DEVIATIONS / dim**0.5 if min_score is None else min_score
    score = F.coalesce(best_score(F.col("text"), train_wide(docs, dim)), F.lit(-1.0))
    return docs.where((score >= least) & ~F.isnan(score))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


QUERIES = {"op10_language": op10_language}
ORACLES: dict[str, str] = {}
