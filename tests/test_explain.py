"""Shapley values against enumeration of all subsets, and sums against predictions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veldrift.operators import explain

NAMES = ["a", "b", "c", "d"]


def worth(nodes, node, x, known):
    """The tree's mean prediction for a row of which only the features in ``known`` are known."""
    f = nodes.feature[node]
    if f < 0:
        return nodes.value[node]
    left, right = nodes.left[node], nodes.right[node]
    if f in known:
        return worth(nodes, left if x[f] <= nodes.cut[node] else right, x, known)
    return (nodes.cover[left] * worth(nodes, left, x, known) + nodes.cover[right] * worth(nodes, right, x, known)) / nodes.cover[node]


def by_subsets(nodes, x):
    n = len(x)
    value = lambda known: sum(worth(nodes, r, x, known) for r in nodes.roots)
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(
            math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (value({*s, i}) - value(set(s)))
            for k in range(n) for s in itertools.combinations(rest, k)
        ))
    return out


@pytest.fixture(scope="module")
def data(spark):
    d = spark.range(600).select("id", *[F.round(F.rand(k), 2).alias(c) for k, c in enumerate(NAMES)])
    d = d.withColumn("label", ((F.col("a") > 0.5) & (F.col("b") < 0.7) | (F.col("c") > 0.9)).cast("double"))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(d).cache()


@pytest.fixture(scope="module", params=["forest", "boosted"])
def model(request, data):
    kind = RandomForestClassifier(numTrees=4, maxDepth=6, seed=1) if request.param == "forest" else GBTClassifier(maxIter=3, maxDepth=4, seed=1)
    return kind.fit(data)


def test_values_equal_all_subsets(spark, data, model):
    nodes = explain.flattened(model, spark)
    x = np.array(data.limit(25).select(*NAMES).collect(), float)
    want = np.array([by_subsets(nodes, r) for r in x])
    for table in (8, 0):  # by tables and row by row
        explain.TABLE, before = table, explain.TABLE
        assert np.allclose(explain.shapley(explain.paths_of(nodes), x), want, atol=1e-10)
        explain.TABLE = before


def test_sums_are_the_prediction_less_the_mean(spark, data, model):
    nodes = explain.flattened(model, spark)
    rows = explain.shap_values(data, NAMES, nodes, ["id", *NAMES]).collect()
    x = np.array([[r[c] for c in NAMES] for r in rows])
    phi = np.array([r.shap for r in rows])
    assert np.allclose(phi.sum(axis=1) + explain.mean_prediction(nodes), nodes.predict(x))
    out = {r["id"]: r for r in model.transform(data).collect()}
    column = "probability" if "Forest" in type(model).__name__ else "rawPrediction"
    assert np.allclose(nodes.predict(x), [out[r["id"]][column][1] for r in rows])
    got = {r.feature: r for r in explain.importance(data, NAMES, nodes).collect()}
    for i, c in enumerate(NAMES):
        assert got[c].mean_abs_shap == pytest.approx(np.abs(phi[:, i]).mean()) and got[c].mean_shap == pytest.approx(phi[:, i].mean(), abs=1e-9) and got[c].n == 600
    assert explain.top_features(explain.importance(data, NAMES, nodes), 2) == sorted(NAMES, key=lambda c: -got[c].mean_abs_shap)[:2]


def test_rows_with_nulls_and_empty_tables(spark, data, model):
    nodes = explain.flattened(model, spark)
    some = data.limit(3).withColumn("b", F.when(F.col("id") % 2 == 0, F.col("b")))
    assert explain.shap_values(some, NAMES, nodes, ["id"]).count() == some.filter("b is not null").count()
    assert explain.importance(data.limit(0), NAMES, nodes).collect() == []
    assert explain.reduced(data.withColumn("target", F.lit(1)), explain.importance(data, NAMES, nodes), top=2).columns[-1] == "target"
