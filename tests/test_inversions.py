"""Inversions and Kendall's tau against all pairs, with many ranges and heavy ties."""

import numpy as np
import pytest

from veldrift.functions import inversions
from veldrift.operators import profiling


def all_pairs(x, y, n):
    less = x[:, None] < x[None, :]
    return int((less & (y[:, None] > y[None, :])).astype(np.int64).ravel() @ np.outer(n, n).ravel())


def test_merging_counts_every_pair():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 3, 64, 101):
        y, w = rng.integers(0, 20, size), rng.integers(1, 5, size)
        want = sum(int(w[i] * w[j]) for i in range(size) for j in range(i + 1, size) if y[i] > y[j])
        assert inversions.inversions(y, w) == want


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot", "line"])
def test_ranges_count_every_pair(spark, kind):
    rng = np.random.default_rng(1)
    x = {"continuous": rng.normal(size=900), "ties": rng.integers(0, 9, 900), "hot": rng.normal(size=900), "line": np.arange(900)}[kind].astype(float)
    y = {"continuous": rng.normal(size=900) + x, "ties": rng.integers(0, 7, 900), "hot": np.where(rng.random(900) < 0.5, 3.0, rng.normal(size=900)), "line": -np.arange(900)}[kind].astype(float)
    values, n = np.unique(np.stack([x, y], axis=1), axis=0, return_counts=True)
    d = spark.createDataFrame([(float(a), float(b), int(m)) for (a, b), m in zip(values, n, strict=True)], "x double, y double, n long").repartition(3)
    want = all_pairs(values[:, 0], values[:, 1], n)
    for rows in (1_000_000, 100):
        assert inversions.discordant(d, rows) == want


def test_tau_of_continuous_columns(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    b += 0.5 * a
    b[:40] = 0.25
    sign = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    ties = 40 * 39 / 2
    pairs = 300 * 299 / 2
    d = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b, strict=True)], "a double, b double")
    got = profiling.kendall(d, "a", "b").first()
    assert got.statistic == pytest.approx(sign.sum() / 2 / np.sqrt(pairs * (pairs - ties)), abs=1e-12) and got.n == 300 and got.pvalue < 1e-6
    assert profiling.kendall(d.limit(0), "a", "b").first().statistic is None
