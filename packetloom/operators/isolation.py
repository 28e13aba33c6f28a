"""M3: isolation forest. Trees grow in parallel on small samples; scoring is vectorised."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREE_ROWS = 256
_NODES = "tree int, node int, feature int, cut double, left int, right int, path double"


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, left, right, path); feature -1 is a leaf."""
    deepest = max(1, math.ceil(math.log2(max(len(points), 2))))
    nodes: list[list] = [[0, -1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(points)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(spread):
            nodes[node][5] = depth + mean_path(len(rows))
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= cut
        for side, part in ((3, rows[goes_left]), (4, rows[~goes_left])):
            nodes[node][side] = len(nodes)
            nodes.append([len(nodes), -1, 0.0, -1, -1, 0.0])
            todo.append((nodes[node][side], part, depth + 1))
        nodes[node][1], nodes[node][2] = feature, cut
    return [tuple(n) for n in nodes]


def _path_lengths(trees: list[tuple[np.ndarray, ...]], points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points))
    for feature, cut, left, right, path in trees:
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            here = at[inner]
            goes_left = points[inner, feature[here]] <= cut[here]
            at[inner] = np.where(goes_left, left[here], right[here])
        total += path[at]
    return total / len(trees)


@dataclass
class IsolationModel:
    """Trees as node tables (at most 511 nodes each) and the score cut of the training rows."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float

    def _samples(self, features: Column) -> Column:
        trees = [
            tuple(part.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
            for _, part in self.nodes.groupby("tree")
        ]
        usual = mean_path(self.sample_size) or 1.0

        @F.pandas_udf(T.DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype="float64")
            points = np.stack(batch.to_numpy()).astype(float)
            return pd.Series(-np.exp2(-_path_lengths(trees, points) / usual))

        return score(features)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``iso_raw`` (negative means anomalous) and ``iso_pred`` (-1 or 1)."""
        scored = df.withColumn("iso_raw", self._samples(F.col(features)) - self.offset)
        return scored.withColumn("iso_pred", F.when(F.col("iso_raw") < 0, -1).otherwise(1))


def _tree_samples(rows: DataFrame, n: int, trees: int, seed: int, tree_rows: int) -> DataFrame:
    """About 2 * ``tree_rows`` rows per tree, exactly all when there are fewer; picked by hash.

    One hash per row thins a big table to the rows some tree might take, so the per-tree
    choice only runs on those. It begins with a word of its own: rows that were split by a
    hash of the same id and seed (ml.split) would else hold none of the lowest hashes.
    """
    wanted = min(1.0, 2 * tree_rows / n)
    kept = min(1.0, wanted * trees)

    def place(*parts: Column) -> Column:
        return F.xxhash64(*parts).cast("double") / 2.0**64 + 0.5

    thin = rows.where(place(F.lit("trees"), F.col("_id"), F.lit(seed)) < kept)
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: place(F.lit("tree"), F.col("_id"), t, F.lit(seed)) < wanted / kept,
    )
    return thin.select("_id", "features", F.explode(chosen).alias("tree"))


def fit_isolation(
    df: DataFrame, id_col: str, features: str = "features", trees: int = 200,
    contamination: float = 0.03, seed: int = 42, min_rows: int = 50,
    tree_rows: int = TREE_ROWS, accuracy: int = 10_000,
) -> IsolationModel | None:
    """Fit on normal rows; None under ``min_rows``.

    Each tree grows on ``tree_rows`` rows: the sample is part of the method. The cut is the
    ``contamination`` quantile of all scores, off by at most 1 / ``accuracy`` of the rows.
    """
    n = df.count()
    if n < min_rows:
        return None
    size = min(tree_rows, n)
    rows = df.select(F.col(id_col).alias("_id"), F.col(features).alias("features"))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        group = group.sort_values("_id").reset_index(drop=True)
        picked = rng.choice(len(group), min(size, len(group)), replace=False)
        points = np.stack(group["features"].to_numpy()[np.sort(picked)]).astype(float)
        return pd.DataFrame(
            [(tree, *node) for node in _grow(points, rng)],
            columns=["tree", "node", "feature", "cut", "left", "right", "path"],
        )

    nodes = _tree_samples(rows, n, trees, seed, tree_rows).groupBy("tree").applyInPandas(grow, _NODES)
    model = IsolationModel(nodes.toPandas(), size, 0.0)
    cut = model.transform(rows).agg(F.percentile_approx("iso_raw", contamination, accuracy)).head()[0]
    return IsolationModel(model.nodes, size, float(cut))
