"""Gradient boosting on binned columns, trees grown leaf by leaf.

Rows are binned once by exact quantiles and written; from then on none leaves its partition. For a tree, each task sums
gradients, hessians and rows by (leaf, feature, bin), and one aggregation adds the tasks' sums. Only the smaller child of a
split is summed; its sibling is the parent less it. The leaf of the largest gain is split first, until the tree has its
leaves. That order needs the children of a leaf before the next choice, so a round sums the children of all leaves that may
still be chosen at once; those not chosen in the end are given up. A tree takes about as many rounds as it is deep.

A model is a set of node arrays (``explain.Nodes``) whose values are raw scores; what the driver holds is bounded by
leaves x features x bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import written
from ..functions.quantiles import percentiles
from . import evaluation as ev
from . import learning
from .explain import Nodes

ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``rounds`` trees of ``leaves``; ``l1`` and ``l2`` penalties; shares of rows and features that a tree sees."""

    rounds: int = 200
    leaves: int = 31
    depth: int = 7
    rate: float = 0.05
    bins: int = 64
    least_rows: int = 20
    l1: float = 0.1
    l2: float = 1.0
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 42
    least_hessian: float = 1e-3
    #: Trees after which the rows' scores are written.
    keep: int = 8


@dataclass
class Leaf:
    """A node of a tree in growth: sums (gradient, hessian, rows) x feature x bin, its best split, and its children."""

    path: str
    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[Leaf, Leaf] | None = None
    slot: int = field(default=-1)


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(leaf: Leaf, features: np.ndarray, s: Settings) -> Leaf:
    """Sets the split of the largest gain; of equal ones the first feature and bin."""
    left = np.cumsum(leaf.sums, axis=2)[:, :, :-1]
    whole = leaf.sums.sum(axis=2, keepdims=True)
    right = whole - left
    worth = lambda x: shrunk(x[0], s.l1) ** 2 / (x[1] + s.l2)
    gain = worth(left) + worth(right) - worth(whole)
    ok = (np.minimum(left[2], right[2]) >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_hessian)
    gain = np.where(ok & np.isin(np.arange(len(gain)), features)[:, None], np.round(gain, 9), 0.0)
    if gain.size and gain.max() > 1e-9 and len(leaf.path) < s.depth:
        leaf.feature, leaf.bin = (int(k) for k in np.unravel_index(gain.argmax(), gain.shape))
        leaf.gain = float(gain[leaf.feature, leaf.bin])
    return leaf


def chosen(root: Leaf, s: Settings) -> tuple[list[Leaf], list[Leaf]]:
    """The splits in order of gain, and the leaves whose children have to be known before more can be chosen."""
    heap, splits = [(-root.gain, root.path, root)], []
    unknown: list[Leaf] = []
    while heap and len(splits) + 1 < s.leaves:
        _, _, leaf = heapq.heappop(heap)
        if leaf.gain <= 0:
            break
        if leaf.children is None:
            unknown = [leaf, *(x for _, _, x in sorted(heap, key=lambda y: y[:2]) if x.gain > 0 and x.children is None)]
            return splits, unknown[: s.leaves - 1 - len(splits)]
        splits.append(leaf)
        for child in leaf.children:
            heapq.heappush(heap, (-child.gain, child.path, child))
    return splits, []


def arrays(root: Leaf, split: Callable[[Leaf], bool], s: Settings) -> tuple[list[tuple], list[Leaf]]:
    """Nodes (feature, bin, left, right, value, rows) of the tree below ``root``, parents first, and its leaves in order."""
    nodes: list[tuple] = []
    ends: list[Leaf] = []
    todo = [root]
    while todo:
        leaf = todo.pop(0)
        g, h, n = leaf.sums[:, 0].sum(axis=1)
        value = float(-s.rate * shrunk(g, s.l1) / (h + s.l2))
        if split(leaf):
            at = len(nodes) + 1 + len(todo)
            nodes.append((leaf.feature, leaf.bin, at, at + 1, value, n))
            todo += leaf.children
        else:
            nodes.append((-1, 0, -1, -1, value, n))
            ends.append(leaf)
        leaf.slot = len(nodes) - 1
    return nodes, ends


def as_nodes(trees: list[list[tuple]], base: float, cuts: list[np.ndarray] | None = None) -> Nodes:
    """Node arrays of all trees; rows of bins go by the bin, with ``cuts`` rows of values by the bins' upper edges."""
    starts = np.cumsum([0, *map(len, trees)])
    rows = [(f, (cuts[f][b] if cuts and f >= 0 else b), left + at if f >= 0 else -1, right + at if f >= 0 else -1, v, n) for at, t in zip(starts, trees, strict=False) for f, b, left, right, v, n in t]
    f, cut, left, right, value, n = (np.array([r[k] for r in rows], float) for k in range(6))
    return Nodes(f.astype(int), cut, left.astype(int), right.astype(int), value, n, starts[:-1].astype(int), base)


def seen(rows: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Whether a tree sees each row (by its hash)."""
    x = rows.view(np.uint64) * ODD + np.uint64((tree + s.seed) * 0xBF58476D1CE4E5B9 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * ODD
    return (x >> np.uint64(11)).astype(float) / 2**53 < s.row_share


def gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return (p - y) * w, p * (1 - p) * w


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(done: Nodes | None, tree: list[tuple], slots: list[int], number: int, features: int, s: Settings):
    """mapInArrow: of each wanted leaf the sums by feature and bin over a partition, a row for each leaf."""
    nodes = as_nodes([tree], 0.0)
    place = np.full(len(tree), -1)
    place[slots] = np.arange(len(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slots), 3, features, s.bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, raw, y, w = _matrix(batch), *(batch.column(c).to_numpy() for c in ("raw", "label", "weight"))
            raw = raw if done is None else raw + done.predict(x)
            g, h = gradients(raw, y, w)
            at = place[nodes.leaves(0, x)]
            at[~seen(batch.column("id").to_numpy(), number, s)] = -1
            mine = at >= 0
            for f in range(features):
                cell = at[mine] * s.bins + x[mine, f]
                for k, v in enumerate((g[mine], h[mine], None)):
                    total[:, k, f] += np.bincount(cell, v, len(slots) * s.bins).reshape(len(slots), s.bins)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["slot", "sums"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v) for v in sorted(rows["sums"])], axis=0)
    return pd.DataFrame({"slot": rows["slot"].iloc[:1], "sums": [total.tobytes()]})


def binned(d: DataFrame, names: list[str], bins: int, key: list[str]) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, x: bins of ``names``, label, weight), written, and each column's inner edges; a value equal to an edge is
    in the bin below it."""
    shares = [k / bins for k in range(1, bins)]
    cuts = [np.unique(np.array([v for v in c if v is not None], float)) for c in percentiles(d, [F.col(c) for c in names], shares)]
    over = lambda c, e: F.size(F.filter(F.array(*[F.lit(float(v)) for v in e]).cast("array<double>"), lambda v: v < F.col(c)))
    x = F.array(*[over(c, e) for c, e in zip(names, cuts, strict=True)])
    rows = d.select(F.xxhash64(*key).alias("id"), x.alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    return written(rows, "binned"), cuts


def fit(d: DataFrame, names: list[str], s: Settings = Settings(), key: tuple[str, ...] = ("ticker", "timestamp")) -> Nodes:  # noqa: B008
    """A model of label by ``names`` for rows complete in them; ``key`` names a row for the choice of rows by tree."""
    rows, cuts = binned(d.dropna(subset=names), names, s.bins, list(key))
    whole = rows.agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).first()
    if not whole["all"] or not 0 < whole["good"] < whole["all"]:
        raise ValueError("boosting needs rows of both classes")
    base = float(np.log(whole["good"] / (whole["all"] - whole["good"])))
    held = written(rows.withColumn("raw", F.lit(base)), "scores")
    rng = np.random.default_rng(s.seed)
    trees: list[list[tuple]] = []
    kept = 0
    for number in range(s.rounds):
        features = np.sort(rng.choice(len(names), max(1, round(s.feature_share * len(names))), replace=False))
        if len(trees) - kept >= s.keep:
            done = as_nodes(trees[kept:], 0.0)
            held, kept = written(held.mapInArrow(_rescored(done), held.schema), "scores"), len(trees)
        done = as_nodes(trees[kept:], 0.0) if len(trees) > kept else None

        def sums(tree: list[tuple], slots: list[int], done=done, number=number) -> dict[int, np.ndarray]:
            parts = held.mapInArrow(_sums(done, tree, slots, number, len(names), s), "slot int, sums binary")
            found = parts.groupBy("slot").applyInPandas(_added, "slot int, sums binary").collect()  # a row for each leaf
            return {r.slot: np.frombuffer(r.sums).reshape(3, len(names), s.bins) for r in found}

        trees.append(grown(sums, features, s))
    return as_nodes(trees, base, cuts)


def _rescored(done: Nodes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("raw").to_numpy() + done.predict(_matrix(batch))
                yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw))

    return run


def grown(sums: Callable[[list[tuple], list[int]], dict[int, np.ndarray]], features: np.ndarray, s: Settings) -> list[tuple]:
    """One tree; ``sums(tree, slots)`` gives the sums of the leaves at ``slots`` of a tree of nodes."""
    root = best_split(Leaf("", sums([(-1, 0, -1, -1, 0.0, 0)], [0])[0]), features, s)
    while True:
        splits, unknown = chosen(root, s)
        if not unknown:
            picked = set(map(id, splits))
            return arrays(root, lambda x: id(x) in picked, s)[0]
        small: list[tuple[Leaf, int]] = []
        for leaf in unknown:
            left = leaf.sums[:, leaf.feature, : leaf.bin + 1].sum(axis=1)
            side = int(left[2] * 2 > leaf.sums[2, leaf.feature].sum())  # 0: the left child has fewer rows
            leaf.children = (Leaf(leaf.path + "0", leaf.sums), Leaf(leaf.path + "1", leaf.sums))
            small.append((leaf, side))
        tree, _ = arrays(root, lambda x: x.children is not None, s)
        found = sums(tree, [leaf.children[side].slot for leaf, side in small])
        for leaf, side in small:
            mine = found[leaf.children[side].slot]
            both = (mine, leaf.sums - mine) if side == 0 else (leaf.sums - mine, mine)
            leaf.children = tuple(best_split(Leaf(leaf.path + str(k), both[k]), features, s) for k in (0, 1))


def probability(model: Nodes, names: list[str]):
    """Column of the probability of the second class."""

    @F.pandas_udf("double")
    def p(*x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-model.predict(np.stack([c.to_numpy(float) for c in x], axis=1)))))

    return p(*[F.col(c) for c in names])


def scored(d: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Metrics on the test rows of a model of the others: model, auc, accuracy, brier, majority."""
    names = learning.resolve(d.columns)
    model = fit(d.filter("part <> 'test'"), names, s)
    test = d.filter("part = 'test'").withColumn("p", probability(model, names))
    return ev.auc(test.select("p", "label"), "p", "label").withColumn("model", F.lit("boosted_by_leaves"))
