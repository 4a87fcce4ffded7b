"""Models by key fitted together against spark.ml fitted one by one, and areas by key against all pairs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veldrift.operators import grouped

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, n in (("A", 300), ("B", 60), ("C", 40), ("flat", 50), ("one", 20)):
        for _ in range(n):
            x = rng.normal(size=3) * [1, 5, 0.1] + [0, 10, -3]
            y = 1.0 if k == "one" else float(x[0] + 0.2 * (x[1] - 10) + rng.normal() > 0)
            rows.append((k, float(x[0]), float(x[1]), 2.0 if k == "flat" else float(x[2]), y, float(rng.integers(1, 4))))
    d = spark.createDataFrame(rows, "ticker string, a double, b double, c double, label double, weight double")
    return d.unionByName(spark.createDataFrame([("A", None, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], d.schema)).repartition(3).cache()


@pytest.mark.parametrize("reg", [1.0, 0.01])
def test_coefficients_equal_spark_ml(spark, data, reg):
    got = {r.ticker: r for r in grouped.fit(data, "ticker", NAMES, reg=reg).collect()}
    assert set(got) == {"A", "B", "C", "flat", "one"}
    for k in ("A", "B", "C", "flat"):
        mine = data.filter((F.col("ticker") == k) & F.col("a").isNotNull())
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, elasticNetParam=0.0, tol=1e-12, maxIter=1000)
        model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), lr]).fit(mine)
        want = [*model.stages[-1].coefficients.toArray(), model.stages[-1].intercept]
        assert np.allclose(got[k].beta, want, atol=1e-6), k
        p = model.transform(mine).select(*NAMES, vector_to_array("probability")[1].alias("want"))
        both = grouped.with_p(mine, spark.createDataFrame([got[k]], "ticker string, n long, mean array<double>, sd array<double>, beta array<double>"), "ticker", NAMES)
        assert np.allclose(sorted(r.p for r in both.collect()), sorted(r.want for r in p.collect()), atol=1e-6)
    assert got["A"].n == 300 and got["one"].beta[:3] == [0, 0, 0] and 1 / (1 + np.exp(-got["one"].beta[3])) == pytest.approx(1 - 1e-6)


def test_jobs_do_not_grow_with_the_keys(spark, data):
    def jobs(d, name):
        spark.sparkContext.setJobGroup(name, name)
        grouped.fit(d, "ticker", NAMES)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    many = data.filter("ticker = 'A'").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("ticker", F.concat(F.lit("k"), "i"))
    assert jobs(many, "many") <= 1.5 * jobs(data.filter("ticker = 'A'"), "single")


def test_area_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for k in range(3) for _ in range(60)] + [(9, 0.5, 1), (9, None, 0)]
    got = {r.k: r for r in grouped.auc_by(spark.createDataFrame(rows, "k int, p double, y int"), "k", "p", "y").collect()}
    for k in range(3):
        pos, neg = ([p for j, p, y in rows if j == k and y == v] for v in (1, 0))
        assert got[k].auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    assert got[9].auc is None and got[9].n == 1
