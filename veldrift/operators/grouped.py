"""A logistic model for each key, all fitted at once.

Every Newton step is one aggregation: tasks sum each key's Hessian and gradient over their rows, so a key's rows never meet,
and the sums of a key give its step. The number of jobs depends on the steps, not on the number of keys.

A key's features are scaled by its own mean and deviation. The loss is the weighted mean log loss plus half of ``reg`` times
the squared coefficients, the intercept free, as spark.ml's logistic regression has it. A key without both classes gets the
share of its class, kept from 0 and 1 by ``EDGE``, whatever the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import written

EDGE = 1e-6


def _scaled(d: DataFrame, key: str, names: list[str], y: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, x, y, w) with scaled features, written; and by key the means, deviations, penalty scales and start."""
    n = range(len(names))
    stats = d.groupBy(key).agg(
        F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in names]).alias("sd"),
        F.sum(F.col(weight) * F.col(y)).alias("good"), F.sum(weight).alias("all"), F.count(F.lit(1)).alias("n"),
    )
    stats = written(stats, "scales")
    z = lambda i, c: F.when(F.col("sd")[i] > 0, (F.col(c) - F.col("mean")[i]) / F.col("sd")[i]).otherwise(0.0)
    rows = d.select(key, *names, F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).join(stats.select(key, "mean", "sd"), key)
    rows = written(rows.select(key, F.array(*[z(i, c) for i, c in enumerate(names)]).alias("x"), "y", "w"), "scaled")
    # The penalty is on coefficients times their column's weighted deviation.
    w = F.col("w")
    spread = [(F.sum(w * F.col("x")[i] * F.col("x")[i]) - F.pow(F.sum(w * F.col("x")[i]), F.lit(2)) / F.sum(w)) / F.nullif(F.sum(w) - F.sum(w * w) / F.sum(w), F.lit(0.0)) for i in n]
    spreads = rows.groupBy(key).agg(F.array(*[F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)) for s in spread]).alias("spread"))
    share = F.greatest(F.lit(EDGE), F.least(1 - F.lit(EDGE), F.try_divide("good", "all")))
    start = F.concat(F.array(*[F.lit(0.0) for _ in n]), F.array(F.log(share / (1 - share))))
    both = (F.col("good") > 0) & (F.col("good") < F.col("all"))
    return rows, written(stats.join(spreads, key).withColumns({"beta": start, "open": both}), "models")


def _sums(names: list[str], key: str):
    """mapInArrow over rows (key, x, y, w, beta): of each key in a batch the sums of Hessian and gradient."""
    size = len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, at = np.unique(batch.column(key).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(of)))
            x = np.concatenate([batch.column("x").flatten().to_numpy().reshape(-1, size - 1), np.ones((batch.num_rows, 1))], axis=1)[order]
            beta = batch.column("beta").flatten().to_numpy().reshape(-1, size)[order]
            y, w = (batch.column(c).to_numpy()[order] for c in ("y", "w"))
            p = 1 / (1 + np.exp(-np.clip((x * beta).sum(axis=1), -500, 500)))
            # The gradient is kept as one more row of the Hessian.
            h = np.concatenate([x[:, :, None] * x[:, None, :] * (w * p * (1 - p))[:, None, None], (x * (w * (y - p))[:, None])[:, None, :]], axis=1)
            sums = np.add.reduceat(h, starts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(of, batch.column(key).type), pa.array([s.tobytes() for s in sums], pa.binary())], [key, "sums"])

    return run


def fit(d: DataFrame, key: str, names: list[str], y: str = "label", weight: str = "weight", reg: float = 1.0, most: int = 50, tol: float = 1e-10) -> DataFrame:
    """(key, n, mean, sd, beta: coefficients of the scaled features and the intercept) for each key of the rows
    complete in ``names`` and ``y``."""
    d = d.dropna(subset=[*names, y, key])
    rows, models = _scaled(d, key, names, y, weight)
    size = len(names) + 1
    kind = d.schema[key].dataType.simpleString()

    def stepped(sums: pd.DataFrame) -> pd.DataFrame:
        one = sums.iloc[:1]
        total = np.sum([np.frombuffer(s) for s in sorted(sums["sums"])], axis=0).reshape(size + 1, size) / one["all"].iloc[0]
        penalty = reg * np.append(np.asarray(one["spread"].iloc[0], float), 0.0)
        beta = np.asarray(one["beta"].iloc[0], float)
        # A column without spread has no part in the loss and keeps its zero.
        step = np.linalg.lstsq(total[:size] + np.diag(penalty), total[size] - penalty * beta, rcond=None)[0]
        step *= min(1.0, 10 / max(np.abs(step).max(), 1e-300))
        return pd.DataFrame({key: one[key], "beta": [(beta + step).tolist()], "moved": [float(np.abs(step).max())]})

    for _ in range(most):
        now = models.filter("open").select(key, "beta", "all", "spread")
        sums = rows.join(now.select(key, "beta"), key).select(key, "x", "y", "w", "beta").mapInArrow(_sums(names, key), f"`{key}` {kind}, sums binary")
        new = sums.join(now, key).groupBy(key).applyInPandas(stepped, f"`{key}` {kind}, beta array<double>, moved double")
        new = new.select(F.col(key).alias("_key"), F.col("beta").alias("_beta"), "moved")
        models = models.drop("moved").join(new, F.col(key) == F.col("_key"), "left").withColumn("beta", F.coalesce("_beta", "beta"))
        models = written(models.drop("_key", "_beta"), "models")
        if (models.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    return models.select(key, "n", "mean", "sd", "beta")


def probability(names: list[str]) -> Column:
    """The second class's probability of rows that have their key's mean, sd and beta."""
    z = F.element_at("beta", len(names) + 1)
    for i, c in enumerate(names):
        z = z + F.when(F.col("sd")[i] > 0, F.col("beta")[i] * (F.col(c) - F.col("mean")[i]) / F.col("sd")[i]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def with_p(d: DataFrame, models: DataFrame, key: str, names: list[str], name: str = "p") -> DataFrame:
    """Rows with the probability by their key's model; null for a key without one."""
    both = d.join(models.select(key, "mean", "sd", "beta"), key, "left")
    return both.withColumn(name, probability(names)).drop("mean", "sd", "beta")


def auc_by(d: DataFrame, key: str, p: str, y: str) -> DataFrame:
    """(key, auc, n) by average ranks of the different values of ``p`` within each key; null without both classes."""
    counts = d.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(key, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("pos"))
    upto = W.partitionBy(key).orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("n").over(upto) - (F.col("n") - 1) / 2)
    pos = F.sum("pos")
    area = F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * (F.sum("n") - pos))
    return ranked.groupBy(key).agg(area.alias("auc"), F.sum("n").alias("n"))
