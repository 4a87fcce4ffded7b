import datetime

import numpy as np
import pytest

from veldrift.operators import learning

NAMES = ["return", "rsi", "log_volume"]


@pytest.fixture(scope="module")
def data(spark):
    """Two series whose label follows the sign of a noisy feature."""
    rng = np.random.default_rng(0)
    rows = []
    for t in ("A", "B"):
        for i in range(500):
            x = rng.normal(size=3)
            y = int(x[0] + 0.5 * rng.normal() > 0.7)
            rows.append((t, datetime.date(2020, 1, 1) + datetime.timedelta(i), *map(float, x), y))
    d = spark.createDataFrame(rows, "ticker string, timestamp date, `return` double, rsi double, log_volume double, target int")
    return learning.prepare(d).cache()


def test_features_are_declared_and_present():
    assert learning.resolve(["rsi", "x", "return"]) == ["return", "rsi"]
    assert learning.resolve(["rsi", "sentiment_score"]) == ["rsi"]
    assert learning.resolve(["rsi", *learning.SENTIMENT]) == ["rsi", *learning.SENTIMENT]


@pytest.mark.parametrize("kind", ["forest", "ridge"])
def test_models_find_a_planted_signal(data, kind):
    r = learning.scored(data, kind).first()
    assert r.auc > 0.85 and r.model == kind


def test_training_comes_before_testing(data):
    r = {x.part: (x.first, x.last) for x in data.groupBy("part").agg({"timestamp": "min"}).withColumnRenamed("min(timestamp)", "first").join(data.groupBy("part").agg({"timestamp": "max"}).withColumnRenamed("max(timestamp)", "last"), "part").collect()}
    assert r["train"][1] < r["validate"][0] <= r["validate"][1] < r["test"][0]


def test_importance_names_the_signal_first(data):
    assert learning.importance(data).first().feature == "return"


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_resampling_evens_the_classes(data, method):
    part = data.filter("ticker = 'A'").limit(200)
    counts = {r.label: r["count"] for r in part.groupBy("label").count().collect()}
    new = learning.resample(part, method).collect()
    few = min(counts, key=counts.get)
    assert len(new) == max(counts.values()) - min(counts.values()) and {r.label for r in new} == {few}
    own = part.filter(f"label = {few}").toPandas()
    for c in NAMES:
        assert own[c].min() - 1e-9 <= min(r[c] for r in new) and max(r[c] for r in new) <= own[c].max() + 1e-9
    with pytest.raises(ValueError):
        learning.resample(part, "other")


def test_weights(data):
    w = learning.resample(data, "balanced")
    by = {r.label: r["sum(weight)"] for r in w.groupBy("label").agg({"weight": "sum"}).collect()}
    assert abs(by[0.0] - by[1.0]) < 1e-6
