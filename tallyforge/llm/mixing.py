"""Mixing a corpus towards target weights with soft domain membership.

A classifier trained on the labelled table gives every document a posterior over
domains. Documents then get nonnegative rates whose expected tokens by domain,
the sum of rate x tokens x posterior, match the targets in the least-squares
sense. The rates are found by projected gradient steps from 1: a step adds to
each rate a combination of the document's posteriors and cuts it at zero. The
Gram matrix of the domains scales the steps, so few are needed. A step is one
aggregate over the documents that returns a number per domain.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, batches, table

#: Domains of a labelled document, in the order of the classifier's classes.
DOMAINS = ("high", "low", "toxic")
#: Shares of the mixture's tokens.
TARGETS = {"high": 0.90, "low": 0.09, "toxic": 0.01}
MAX_TRAINING = 20_000
FEATURES = 1 << 13


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) as a class number; rows without both labels or a doc_id are no training rows, and of several for one doc_id the worst counts."""
    domain = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).otherwise(0.0)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))


def words_of(text: Column) -> Column:
    """Runs without control characters and spaces, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x20]+"), lambda w: w != "")


def fit_classifier(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> PipelineModel | None:
    """Multinomial logistic regression on hashed words, from at most about ``max_training`` labelled rows drawn by a hash of doc_id.

    None where no row is labelled or all carry one domain.
    """
    domains = domain_of(labels)
    n = domains.count()
    if n > max_training:
        domains = domains.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(max_training / n * (1 << 30)))
    rows = docs.select("doc_id", "text").join(domains, "doc_id").select(F.array_distinct(words_of(F.col("text"))).alias("_words"), "domain")
    if rows.select("domain").distinct().count() < 2:
        return None
    model = LogisticRegression(featuresCol="_features", labelCol="domain", probabilityCol="_posterior", rawPredictionCol="_raw", predictionCol="_domain", family="multinomial", maxIter=30, regParam=1e-3)
    return Pipeline(stages=[HashingTF(inputCol="_words", outputCol="_features", numFeatures=FEATURES, binary=True), model]).fit(rows)


def scored(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``rows`` (with text; no column named p or starting with an underscore is read) with ``p``, the posterior of each domain; without a model every domain is as likely."""
    if model is None:
        return rows.withColumn("p", F.array(*[F.lit(1.0 / len(DOMAINS))] * len(DOMAINS)))
    p, classes = vector_to_array("_posterior"), model.stages[-1].numClasses
    seen = model.transform(rows.withColumn("_words", F.array_distinct(words_of(F.col("text")))))
    return seen.withColumn("p", F.array(*[F.get(p, F.lit(k)) if k < classes else F.lit(0.0) for k in range(len(DOMAINS))])).select(*rows.columns, "p")


def posteriors(docs: DataFrame, model: PipelineModel | None, tokens: Column | None = None) -> DataFrame:
    """(doc_id, tokens, p): tokens of the text, its words unless ``tokens`` counts them otherwise, and the posterior of each domain."""
    count = F.size(words_of(F.col("text"))) if tokens is None else tokens
    return scored(docs.select("doc_id", "text", count.cast("long").alias("tokens")), model).select("doc_id", "tokens", "p")


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after these steps, from each document's posterior alone; the posterior is read once and carried along."""
    if not steps:
        return F.lit(1.0)
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def move(at: Column, s: Column) -> Column:
        change = sum((s[k] * at["p"][k] for k in range(1, len(DOMAINS))), s[0] * at["p"][0])
        return F.struct(F.greatest(F.lit(0.0), at["rate"] + change).alias("rate"), at["p"].alias("p"))

    return F.aggregate(literal, F.struct(F.lit(1.0).alias("rate"), F.col("p").alias("p")), move, lambda at: at["rate"])


def _state(spread: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain, and the Gram matrix of the rows whose rate is above zero."""
    k = len(DOMAINS)
    rows = spread.select("tokens", "p", _rate(steps).alias("r"))
    alive = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
    mass = [F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]).alias(f"m{i}") for i in range(k)]
    gram = [F.sum(alive * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}{j}") for i in range(k) for j in range(i + 1)]
    row = rows.agg(*mass, *gram).first()
    have = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    return have, np.array([[row[f"g{max(i, j)}{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


@dataclass
class Fit:
    """Steps that give the rates, and the wanted and reached tokens by domain; ``settled`` if no further step would help."""

    steps: list[np.ndarray]
    want: np.ndarray
    reached: np.ndarray
    settled: bool

    @property
    def residual(self) -> float:
        """How far the reached tokens are from the wanted ones, by all wanted."""
        return float(np.linalg.norm(self.reached - self.want) / max(self.want.sum(), 1.0))


def fit(spread: DataFrame, targets: dict[str, float], max_steps: int = 40, tolerance: float = 1e-6) -> Fit:
    """Rates for ``spread`` (tokens, p).

    The mixture's size is such that the first domain keeps its present tokens. A
    domain without any mass has no target. A step that would not lower the
    squared distance is halved until it does; where none does, the targets can't
    be met any closer. Running out of steps before that is warned of.
    """
    have, gram = _state(spread, [])
    if have.sum() <= 0:
        return Fit([], have, have, True)
    weights = np.array([targets[d] for d in DOMAINS])
    want = weights * (have[0] / weights[0] if have[0] > 0 and weights[0] > 0 else have.sum())
    want[have <= 0] = 0
    steps: list[np.ndarray] = []
    move = None
    for _ in range(max_steps):
        if np.abs(have - want).max() <= tolerance * want.sum():
            return Fit(steps, want, have, True)
        move = np.linalg.pinv(gram, rcond=1e-9) @ (want - have) if move is None else move / 2
        there, gram_there = _state(spread, [*steps, move])
        if np.linalg.norm(there - want) < np.linalg.norm(have - want):
            steps, have, gram, move = [*steps, move], there, gram_there, None
        elif np.abs(move).max() < 1e-9:
            return Fit(steps, want, have, True)
    found = Fit(steps, want, have, bool(np.abs(have - want).max() <= tolerance * want.sum()))
    if not found.settled:
        warnings.warn(f"mixing rates are not settled after {max_steps} steps; the token totals are off by {found.residual:.2g} of all", stacklevel=2)
    return found


def fit_rates(spread: DataFrame, targets: dict[str, float], max_steps: int = 40, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps and the wanted tokens of ``fit``."""
    found = fit(spread, targets, max_steps, tolerance)
    return found.steps, found.want


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_training: int = MAX_TRAINING, tokens: Column | None = None) -> DataFrame:
    """(doc_id, tokens, p, rate, residual) of every row of ``docs``; residual is the same for all, see ``Fit``.

    ``tokens`` counts a row's tokens, else its words are counted. A null or blank
    text has no words; its rate follows from its posterior and weighs nothing.
    Repeated rows count each. Extra columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    with batches(scratch.spark):
        spread = scratch.save(posteriors(docs, fit_classifier(docs, labels, max_training), tokens), "posteriors")
    found = fit(spread, targets or TARGETS)
    return spread.withColumn("rate", _rate(found.steps)).withColumn("residual", F.lit(found.residual))


def draws(rate: Column) -> Column:
    """How often a row of that rate is drawn: floor(rate + u), u being a hash of doc_id and text in 0..1."""
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_training: int = MAX_TRAINING, tokens: Column | None = None) -> DataFrame:
    """``docs`` drawn at their rates (see ``mixing_rates`` and ``draws``), with the columns of ``docs``.

    Documents of the first domain have rates of about 1 or more, since the
    mixture's size keeps that domain's tokens. Equal rows are drawn alike. Null
    doc_ids and null or blank texts are rows like any other. An empty table gives
    an empty result. Rows are scored a second time as they are drawn, so that
    texts are neither shuffled nor stored on the way.
    """
    model = fit_classifier(docs, labels, max_training)
    scratch = Scratch(docs.sparkSession, "mix")
    with batches(scratch.spark):
        spread = scratch.save(posteriors(docs, model, tokens).select("tokens", "p"), "posteriors")
    found = fit(spread, targets or TARGETS)
    scratch.drop()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    drawn = scored(rows, model).withColumn("_times", draws(_rate(found.steps)))
    return drawn.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "residual")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
