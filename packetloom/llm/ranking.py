"""Quality scores by Bradley-Terry ranking of labelled pairs.

A document's strength is linear in features of its text. The chance that a good document beats a
bad one is the logistic function of their difference, and the weights maximise the likelihood
of sampled pairs. A quantile of the labelled strengths becomes the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import bounded_sample, texts
from packetloom.llm.text_stats import RATES, measure, with_stats

THRESHOLD = 0.7


@dataclass(frozen=True)
class Ranker:
    """Knots of each statistic, weights of the basis, and the scale of the score."""

    centre: np.ndarray
    spread: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def basis(self, rates: np.ndarray) -> np.ndarray:
        """Each statistic, standardised and clipped, and its excess over the knots."""
        z = np.clip((rates - self.centre) / self.spread, -6, 6)
        return np.hstack([z, *(np.maximum(z - k, 0) for k in self.knots)])

    def strength(self, rates: np.ndarray) -> np.ndarray:
        return self.basis(rates) @ self.weights

    def score(self, rates: np.ndarray) -> np.ndarray:
        """0 to 1; the chosen quantile of the strengths gets THRESHOLD."""
        odds = self.slope * (self.strength(rates) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(
    rates: np.ndarray, good: np.ndarray, rounds: int = 500, pairs: int = 1024, rate: float = 0.05,
    penalty: float = 1e-4, seed: int = 7,
) -> Ranker:
    """Weights by stochastic descent (Adam) on fresh pairs in each round.

    Without rows of both kinds all strengths are equal and every score is THRESHOLD.
    """
    width = len(RATES)
    rates = rates.reshape(-1, width)
    centre = np.median(rates, axis=0) if len(rates) else np.zeros(width)
    spread = rates.std(axis=0) + 1e-6 if len(rates) else np.ones(width)
    knots = np.array([-1.0, 0.0, 0.5, 1.0, 2.0])
    blank = Ranker(centre, spread, knots, np.zeros(width * 6), 0.0, 1.0)
    if not len(rates) or good.all() or not good.any():
        return blank
    data, random = blank.basis(rates), np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    weights, first, second = np.zeros(data.shape[1]), 0.0, 0.0
    for step in range(1, rounds + 1):
        ahead = data[random.choice(better, pairs)] - data[random.choice(worse, pairs)]
        lost = 1 / (1 + np.exp(np.clip(ahead @ weights, -30, 30)))
        slope = penalty * weights - (lost[:, None] * ahead).mean(axis=0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    strength = data @ weights
    cut = _threshold(strength, good)
    return Ranker(centre, spread, knots, weights, cut, _slope(strength - cut, good))


def _threshold(strength: np.ndarray, good: np.ndarray) -> float:
    """The quantile of all strengths that gives the best mean accuracy of the two kinds."""
    marks = np.quantile(strength, np.linspace(0.001, 0.999, 999))
    passed = strength[None, :] >= marks[:, None]
    worth = passed[:, good].mean(axis=1) + (~passed[:, ~good]).mean(axis=1)
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    return float(marks[best].mean())


def _slope(away: np.ndarray, good: np.ndarray) -> float:
    """The steepness under which the scores are most likely."""
    choices = np.geomspace(0.05, 20, 60)
    offset = np.log(THRESHOLD / (1 - THRESHOLD))
    sign = np.where(good, -1.0, 1.0)
    loss = [np.logaddexp(0, sign * (s * away + offset)).mean() for s in choices]
    return float(choices[int(np.argmin(loss))])


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> Ranker:
    """A ranker from at most about ``sample_rows`` labelled documents (by a hash of the id)."""
    known = labels.select("doc_id", F.col("quality").alias("__good")).dropna()
    known = bounded_sample(known, "doc_id", sample_rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    data = with_stats(taught, ("doc_id", "__good")).toPandas().sort_values(["doc_id", "__good"])
    return fit(data[list(RATES)].to_numpy(), data["__good"].to_numpy() == 1)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score and strength of every row; empty and null texts get the score of no words.

    Repeated rows are scored each; a null id stays null; other columns are not read.
    """
    schema = pa.schema(
        [pa.field("doc_id", pa.int64()), pa.field("score", pa.float64()), pa.field("strength", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = np.array([measure(t)[1] for t in texts(batch)]).reshape(-1, len(RATES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ranker.score(rates)),
                 pa.array(ranker.strength(rates))], schema=schema,
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, score double, strength double"
    )
