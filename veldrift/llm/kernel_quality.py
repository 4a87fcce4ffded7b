"""Quality scores by kernel ridge regression on random Fourier features, with isotonic calibration.

1. Every whole text is read once into ten statistics (``quality.FEATURES``), kept in a narrow table.
2. Statistics are scaled by the mean and deviation of the rows learned from. ``features`` random cosines of them approximate
   a Gaussian kernel of width ``width``.
3. The normal equations are summed by partition, one matrix for each of ``folds`` folds of the documents; a fold's matrix
   and the sum of all give the ridge solution without that fold, and that of all. Rows of the matrices, not documents, meet.
   The penalty is that of ``ridges`` with the least squared error over the folds left out, which the matrices tell too.
4. Scores of documents by the solution without their own fold are counted on a grid of ``cells`` and pooled to a
   non-decreasing share of good documents. Between the centres of the pools the final score is interpolated.

All labelled documents outside ``held_out`` are learned from, without a bound: what reaches the driver are ``features``
squared numbers and ``cells`` counts.

Defined results: null text is empty, and an empty text gets the score of its statistics (zeros) like any other; a document
without id is not learned from and not held out; of several labels of one document the least counts; rows that share a
doc_id are learned from each; labels that are not 0 or 1 do not count. Without both classes there is nothing to learn: every
score is the share of good labels (0.5 without any). An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .quality import FEATURES, document_statistics

THRESHOLD = 0.3
COLUMNS = [f"x{k}" for k in range(len(FEATURES))]


def statistics_udf():
    @F.pandas_udf(", ".join(f"{c} double" for c in COLUMNS))
    def statistics(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(document_statistics(texts.tolist())[1], columns=COLUMNS)

    return statistics


@dataclass(frozen=True)
class Kernel:
    """Random Fourier features: cosines of ``(x - mean) / scale @ waves + shifts``, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -4, 4) @ self.waves + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    #: Raw scores and the calibrated scores there; in between by straight lines.
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.kernel.features(x) @ self.weights, self.knots, self.values)


def kernel(mean: np.ndarray, scale: np.ndarray, features: int = 256, width: float = 3.0, seed: int = 0) -> Kernel:
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(len(mean), features)) / width
    return Kernel(mean, np.where(scale > 0, scale, 1.0), waves, rng.uniform(0, 2 * np.pi, features))


def _inputs(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COLUMNS], axis=1)


def _sums(k: Kernel, folds: int):
    """mapInArrow: the partition's normal equations, a row (fold, row, values) for each row of each fold's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(k.shifts) + 1
        total = np.zeros((folds, size, size + 1))
        seen = np.zeros(folds, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y, fold = k.features(_inputs(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                mine = z[fold == f]
                total[f, :, :size] += mine.T @ mine
                total[f, :, size] += mine.T @ y[fold == f]
                seen[f] = True
        for f in np.flatnonzero(seen):
            rows = pa.array([r.tobytes() for r in total[f]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, f, np.int32)), pa.array(np.arange(size, dtype=np.int32)), rows], ["fold", "row", "values"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The partitions' sums of one matrix row; in the order of their bytes, so that reruns agree to the last bit."""
    total = np.sum([np.frombuffer(v) for v in sorted(rows["values"])], axis=0)
    return pd.DataFrame({"fold": rows["fold"].iloc[:1], "row": rows["row"].iloc[:1], "values": [total.tobytes()]})


def _cells(k: Kernel, without: np.ndarray, cells: int):
    """mapInArrow: (cell, y) of each row by the weights found without the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = k.features(_inputs(batch)), batch.column("fold").to_numpy()
            raw = (z * without[fold]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(raw, cells)), batch.column("y")], ["cell", "y"])

    return run


def cell_of(raw: np.ndarray, cells: int) -> np.ndarray:
    """Cells of equal width from -1 to 2; beyond, the outermost."""
    return np.clip(np.floor((raw + 1) / 3 * cells), 0, cells - 1).astype(np.int32)


def pooled(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares ``good / n`` of least squared error, by pooling neighbours that fall: centres and shares."""
    pools: list[list[float]] = []  # sum of places, good, n
    for a, g, m in zip(at, good, n, strict=True):
        pools.append([a * m, g, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the least squared error plus ``ridge`` for each row summed; the constant is the last feature."""
    size = len(sums)
    return np.linalg.solve(sums[:, :size] + ridge * (1 + sums[-1, size - 1]) * np.eye(size), sums[:, size])


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    """Of the rows summed; y is 0 or 1, so its squares add up to the constant's product with it."""
    size = len(sums)
    return float(sums[-1, size] - 2 * weights @ sums[:, size] + weights @ sums[:, :size] @ weights)


def fit(
    rows: DataFrame, features: int = 256, width: float = 3.0, ridges: tuple[float, ...] = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6),
    folds: int = 4, cells: int = 3000, seed: int = 0,
) -> Model | None:
    """Fit on all ``rows`` (the statistics, y of 0 or 1, fold from 0 to ``folds`` - 1); None without both classes."""
    moments = [f(c).alias(f"{name}{c}") for c in COLUMNS for name, f in (("mean", F.mean), ("sd", F.stddev_pop))]
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), *moments).first()
    if not m["n"] or m["good"] in (0, m["n"]):
        return None
    k = kernel(np.array([m[f"mean{c}"] for c in COLUMNS]), np.array([m[f"sd{c}"] for c in COLUMNS]), features, width, seed)
    with small_batches(rows.sparkSession, 4096):
        parts = stored(rows.mapInArrow(_sums(k, folds), "fold int, row int, values binary"), "equations")
        sums = stored(parts.groupBy("fold", "row").applyInPandas(_added, "fold int, row int, values binary"), "sums").collect()
        size = features + 1
        total = np.zeros((folds, size, size + 1))
        for r in sums:
            total[r["fold"], r["row"]] = np.frombuffer(r["values"])
        whole = total.sum(axis=0)
        ridge = min(ridges, key=lambda r: sum(squared_error(t, solved(whole - t, r)) for t in total))
        without = np.stack([solved(whole - t, ridge) for t in total])
        counts = rows.mapInArrow(_cells(k, without, cells), "cell int, y double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
        held = sorted((r["cell"], r["n"], r["good"]) for r in counts.collect())
    cell, n, good = (np.array(c, float) for c in zip(*held, strict=True))
    return Model(k, solved(whole, ridge), *pooled((cell + 0.5) / cells * 3 - 1, good, n))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 4, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score from 0 to 1, predicted (1 from ``threshold`` on)."""
    all_rows = stored(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), statistics_udf()("text").alias("s")).select("doc_id", "held_out", "s.*"), "statistics")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    learned = all_rows.filter("not held_out").join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int"))
    learned = stored(learned.select(*COLUMNS, "y", "fold"), "learned")
    model = fit(learned, folds=folds, **options)
    if model is None:
        share = learned.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
        score = F.lit(float(share))
    else:

        @F.pandas_udf("double")
        def scored(*x: pd.Series) -> pd.Series:
            return pd.Series(np.clip(model.score(np.stack([c.to_numpy() for c in x], axis=1)), 0, 1))

        score = scored(*COLUMNS)
    rows = all_rows.select("doc_id", "held_out", score.alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
