"""Shapley values of tree models, exact for the trees as they are: features left out follow the training rows' shares.

Trees are flattened into node arrays of bounded size, which every task gets. A leaf's path is one interval for each different
feature on it; whether a row lies within an interval is all that counts, so a leaf of few features has a table of its
contributions by those yes and no, and a batch of rows looks its own up. Nothing but sums by feature leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import scratch, written
from . import learning

#: Features of a path up to which its contributions are kept as a table (of two to that power rows).
TABLE = 8


@dataclass(frozen=True)
class Nodes:
    """Nodes of all trees: a node of feature -1 is a leaf; a row goes left if its value is at most the cut. ``cover`` is the
    number (or weight) of training rows; the prediction is the sum of the leaves' values plus ``base``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    base: float = 0.0

    def leaves(self, root: int, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in one tree."""
        node = np.full(len(x), root)
        rows = np.arange(len(x))
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node]
            down = np.where(x[rows, f] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for root in self.roots:
            out += self.value[self.leaves(root, x)]
        return out


def flattened(model, spark) -> Nodes:
    """Nodes of a fitted forest or boosted model of spark.ml, read from its saved form: probabilities of the second class
    for a forest of classes, else predictions, each by its tree's weight."""
    path = scratch(spark, "trees")
    model.save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # the model's own size
    forest = type(model).__name__.startswith("RandomForest")
    weights = [1 / len(model.trees)] * len(model.trees) if forest else list(model.treeWeights)
    starts = {}
    for i, r in enumerate(saved):
        starts.setdefault(r.treeID, i - r.id)
    stats = lambda r: r.impurityStats[1] / sum(r.impurityStats) if forest and "Classification" in type(model).__name__ else r.prediction
    child = lambda r, c: starts[r.treeID] + c if c >= 0 else -1
    column = lambda f, kind=float: np.array([f(r) for r in saved], kind)
    return Nodes(
        column(lambda r: r.split.featureIndex if r.leftChild >= 0 else -1, int), column(lambda r: r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else np.nan),
        column(lambda r: child(r, r.leftChild), int), column(lambda r: child(r, r.rightChild), int),
        column(lambda r: weights[r.treeID] * stats(r)), column(lambda r: r.rawCount), np.array(sorted(starts.values())),
    )


@dataclass(frozen=True)
class Path:
    """One leaf: its different features, their intervals (low, high], the shares of training rows within, and its value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    table: np.ndarray | None


def contributions(share: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Shapley values of the game whose worth for a set S is the product of ``inside`` over S and of ``share`` over the
    others, for rows of ``inside``: rows x features."""
    rows, m = inside.shape
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for i in range(m):
        p = np.zeros((rows, m))  # by size of S: the products over all S without i
        p[:, 0] = 1
        for j in range(m):
            if j != i:
                p[:, 1:] = p[:, 1:] * share[j] + p[:, :-1] * inside[:, j : j + 1]
                p[:, 0] *= share[j]
        out[:, i] = (inside[:, i] - share[i]) * (p @ weight)
    return out


def paths_of(nodes: Nodes) -> list[Path]:
    out = []
    todo = [(int(r), {}) for r in nodes.roots]
    while todo:
        node, within = todo.pop()
        f = int(nodes.feature[node])
        if f < 0:
            if within:
                low, high, share = (np.array([v[k] for v in within.values()]) for k in range(3))
                table = None
                if len(within) <= TABLE:
                    cases = (np.arange(2 ** len(within))[:, None] >> np.arange(len(within)) & 1).astype(float)
                    table = contributions(share, cases) * nodes.value[node]
                out.append(Path(np.array(list(within)), low, high, share, float(nodes.value[node]), table))
            continue
        low, high, share = within.get(f, (-np.inf, np.inf, 1.0))
        for child, a, b in ((nodes.left[node], low, min(high, nodes.cut[node])), (nodes.right[node], max(low, nodes.cut[node]), high)):
            part = nodes.cover[child] / nodes.cover[node] if nodes.cover[node] else 0.0
            todo.append((int(child), {**within, f: (a, b, share * part)}))
    return out


def mean_prediction(nodes: Nodes) -> float:
    """The prediction without any feature: leaves by their shares of training rows."""
    share = np.zeros(len(nodes.feature))
    share[nodes.roots] = 1
    for node in range(len(share)):  # children come after their parents
        if nodes.feature[node] >= 0:
            for child in (nodes.left[node], nodes.right[node]):
                share[child] = share[node] * nodes.cover[child] / max(nodes.cover[node], 1e-300)
    return float(nodes.base + (share * nodes.value * (nodes.feature < 0)).sum())


def shapley(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """Contributions of each feature to each row's prediction: rows x features."""
    out = np.zeros(x.shape)
    for p in paths:
        v = x[:, p.features]
        inside = (v > p.low) & (v <= p.high)
        if p.table is not None:
            out[:, p.features] += p.table[inside @ (1 << np.arange(len(p.features)))]
        else:
            out[:, p.features] += contributions(p.share, inside.astype(float)) * p.value
    return out


def shap_values(d: DataFrame, names: list[str], nodes: Nodes, key: list[str], rows: int = 2048) -> DataFrame:
    """``key`` and shap, an array of the contributions in the order of ``names``, of rows complete in ``names``."""
    paths = paths_of(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                x = np.stack([some.column(c).cast(pa.float64()).to_numpy() for c in names], axis=1)
                phi = pa.FixedSizeListArray.from_arrays(pa.array(shapley(paths, x).ravel()), len(names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in key), phi], [*key, "shap"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*key).schema)
    return d.dropna(subset=names).select(*dict.fromkeys([*key, *names])).mapInArrow(run, f"{kinds}, shap array<double>")


def importance(d: DataFrame, names: list[str], nodes: Nodes, rows: int = 2048) -> DataFrame:
    """(feature, mean_abs_shap, mean_shap, n, rank) over all complete rows; each batch hands on one sum for a feature."""
    paths = paths_of(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                phi = shapley(paths, np.stack([c.cast(pa.float64()).to_numpy() for c in some.columns], axis=1))
                columns = [pa.array(names), pa.array(np.abs(phi).sum(axis=0)), pa.array(phi.sum(axis=0)), pa.array([some.num_rows] * len(names), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "a", "s", "n"])

    sums = d.dropna(subset=names).select(*names).mapInArrow(run, "feature string, a double, s double, n long")
    out = sums.groupBy("feature").agg((F.sum("a") / F.sum("n")).alias("mean_abs_shap"), (F.sum("s") / F.sum("n")).alias("mean_shap"), F.sum("n").alias("n"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs_shap"), "feature")))  # a row for each feature


def forest_importance(d: DataFrame, trees: int = 200, depth: int = 5) -> DataFrame:
    """Shapley importance of a forest of the training rows, over all test rows. Features are scaled within the model, so the
    rows explained are those that its trees see."""
    names = learning.resolve(d.columns)
    model = learning.fit(d.filter("part <> 'test'"), "forest", trees=trees, depth=depth)
    seen = model.transform(d.filter("part = 'test'")).select(*[F.get(vector_to_array("features"), i).alias(n) for i, n in enumerate(names)])
    return importance(seen, names, flattened(model.stages[-1], d.sparkSession))


def top_features(importances: DataFrame, top: int = 15) -> list[str]:
    """The names of the most important features, the first of equals by name."""
    return [r.feature for r in importances.orderBy("rank").limit(top).collect()]


def reduced(d: DataFrame, importances: DataFrame, y: str = "target", top: int = 15) -> DataFrame:
    """``d`` with its key, the most important features and the target alone."""
    return written(d.select(*[c for c in ("ticker", "timestamp") if c in d.columns], *top_features(importances, top), *([y] if y in d.columns else [])), "reduced")
