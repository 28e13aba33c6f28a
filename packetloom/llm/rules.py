"""Quality rules as a decision list that is learned from labelled statistics.

Sequential covering: a rule starts empty and grows by the threshold that gains most on two
thirds of the labelled rows; it is pruned on the remaining third and kept while it stays precise there;
the rows it covers leave; and so on. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import bounded_sample, shielded
from packetloom.llm.text_stats import RATES, with_stats


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def mask(self, data: pd.DataFrame) -> np.ndarray:
        values = data[self.name].to_numpy()
        return values > self.cut if self.above else values <= self.cut

    def column(self) -> Column:
        value = F.col(self.name)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, data: pd.DataFrame) -> np.ndarray:
    found = np.ones(len(data), bool)
    for condition in rule:
        found &= condition.mask(data)
    return found


def _thresholds(data: pd.DataFrame, names: tuple[str, ...], steps: int) -> list[Condition]:
    """Cuts half way between neighbouring quantiles of all rows."""
    out = []
    for name in names:
        marks = np.unique(np.quantile(data[name], np.linspace(0, 1, steps + 1)))
        for cut in (marks[:-1] + marks[1:]) / 2:
            out += [Condition(name, True, float(cut)), Condition(name, False, float(cut))]
    return out


def _grow(masks: np.ndarray, choices: list[Condition], bad: np.ndarray, longest: int) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        p = masks[:, inside & bad].sum(axis=1)
        n = masks[:, inside & ~bad].sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        rule.append(choices[best])
        inside &= masks[best]
    return tuple(rule)


def _prune(rule: Rule, data: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The leading conditions with the best (p - n) / (p + n) on rows not grown on."""

    def worth(k: int) -> float:
        inside = covers(rule[:k], data)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def learn(
    data: pd.DataFrame, bad: np.ndarray, names: tuple[str, ...] = RATES, steps: int = 40,
    longest: int = 4, most_rules: int = 24, precision: float = 0.9, least: int = 3,
) -> list[Rule]:
    """Ordered rules that reject. No labelled rows, or of one kind only: no rules.

    ``precision`` must hold, on all labelled rows still uncovered and on those kept for
    pruning; a rule must cover ``least`` bad rows.
    """
    rules: list[Rule] = []
    if not len(data) or bad.all() or not bad.any():
        return rules
    choices = _thresholds(data, names, steps)
    grown_on = np.arange(len(data)) % 3 > 0
    left = np.ones(len(data), bool)
    masks = np.array([c.mask(data) for c in choices])
    while len(rules) < most_rules and (left & bad).sum() >= least:
        grow, prune = left & grown_on, left & ~grown_on
        if not (grow & bad).any():
            break
        rule = _grow(masks[:, grow], choices, bad[grow], longest)
        if not rule:
            break
        if (prune & bad).any():
            rule = _prune(rule, data[prune], bad[prune])
        inside = covers(rule, data) & left
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        held, wrong = (inside & prune & bad).sum(), (inside & prune & ~bad).sum()
        if p < least or p / (p + n) < precision or (held + wrong and held / (held + wrong) < precision):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_from(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, **options: object
) -> list[Rule]:
    """Rules from at most about ``sample_rows`` labelled documents; label 0 is bad.

    The sample is chosen by a hash of the id. Rows without label or id teach nothing.
    """
    known = labels.select("doc_id", F.col("quality").alias("__good")).dropna()
    known = bounded_sample(known, "doc_id", sample_rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    data = with_stats(taught, ("doc_id", "__good")).toPandas().sort_values(["doc_id", "__good"])
    return learn(data.reset_index(drop=True), data["__good"].to_numpy() == 0, **options)


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of every text with ``base_failed``, the first ``rule`` that rejects and ``kept``.

    An empty or null text has no words and fails the base test. Repeated rows are judged
    alike, each on its own. A null id stays null.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        with_stats(docs, keep).withColumn("base_failed", base).withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def passing(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever those are called."""
    hidden, restore = shielded(docs, "doc_id", "text")
    return restore(judge(hidden, rules, tuple(hidden.columns)).where("kept"))
