"""Order statistics by refined ranges against sorting, with sketches coarse enough for several rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.functions import quantiles

VALUES = {
    "normal": lambda rng: rng.normal(size=3000),
    "wide": lambda rng: np.exp(rng.normal(size=3000) * 20),
    "ties": lambda rng: rng.integers(0, 4, 3000).astype(float),
    "same": lambda rng: np.full(3000, 7.5),
    "spike": lambda rng: np.where(rng.random(3000) < 0.9, 1.0, rng.normal(size=3000)),
    "odd": lambda rng: np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000)),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    columns = [f(rng).tolist() for f in VALUES.values()]
    d = spark.createDataFrame(list(zip(*columns, strict=True)), [*VALUES]).repartition(5)
    return columns, d.withColumn("odd", F.when(F.col("same") > 0, F.col("odd"))).cache()


@pytest.mark.parametrize("accuracy, exact", [(10_000, 5_000), (50, 20)])
def test_ranks_equal_sorting(table, accuracy, exact):
    columns, d = table
    plain = [sorted(v for v in c if v == v) for c in columns]
    ranks = [[1, len(v) // 3, len(v) // 3 + 1, len(v)] for v in plain]
    got = quantiles.order_statistics(d, [F.col(c) for c in VALUES], ranks, accuracy, exact)
    for r, v, g in zip(ranks, plain, got, strict=True):
        assert g == {k: v[k - 1] for k in r}


def test_percentiles_interpolate(spark, table):
    columns, d = table
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    for accuracy, exact, alone in ((10_000, 5_000, 0), (200, 100, 0), (10_000, 5_000, 10**6)):
        got = quantiles.percentiles(d, [F.col(c) for c in VALUES], shares, accuracy, exact, alone)
        for c, g in zip(columns, got, strict=True):
            assert np.allclose(g, np.quantile([v for v in c if v == v], shares), rtol=1e-12)
    none = spark.createDataFrame([(None, 1)], "x double, y int")
    for alone in (0, 10**6):
        assert quantiles.percentiles(none, [F.col("x"), F.col("y")], [0.25, 0.5], alone=alone) == [[None, None], [1.0, 1.0]]
    assert quantiles.percentiles(none.limit(0), [F.col("x")], [0.5]) == [[None]]
