"""Kernel ridge by random features: sums against plain numpy, pooling against brute force, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.llm import kernel_quality as kq

from .cases import frame

SMALL = "/root/testdata/sf0.01"


def tables(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_model_equals_plain_numpy(spark):
    """The fold sums of the partitions give the weights, the chosen penalty and the calibration that numpy finds on all rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(kq.COLUMNS)))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    fold = rng.integers(0, 4, 400)
    rows = spark.createDataFrame([(*map(float, a), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], [*kq.COLUMNS, "y", "fold"])
    rows = rows.withColumn("fold", F.col("fold").cast("int")).repartition(5)
    model = kq.fit(rows, features=40, cells=100)
    k = kq.kernel(x.mean(axis=0), x.std(axis=0), 40)
    z = k.features(x)
    weights = lambda mine, r: np.linalg.solve(z[mine].T @ z[mine] + r * (1 + mine.sum()) * np.eye(41), z[mine].T @ y[mine])

    def raw(r):
        w = np.stack([weights(fold != f, r) for f in range(4)])
        return (z * w[fold]).sum(axis=1)

    best = min((1e-2, 1e-3, 1e-4, 1e-5, 1e-6), key=lambda r: ((raw(r) - y) ** 2).sum())
    assert np.allclose(model.weights, weights(np.ones(400, bool), best), atol=1e-7)
    cell = kq.cell_of(raw(best), 100)
    at = np.unique(cell)
    centres, values = kq.pooled((at + 0.5) / 100 * 3 - 1, np.array([y[cell == c].sum() for c in at]), np.array([(cell == c).sum() for c in at]))
    assert np.allclose(model.values, values) and np.allclose(model.knots, centres)


def test_pooled_is_the_best_rising_line():
    """No other non-decreasing choice of shares has a smaller squared error (checked by dynamic programming on a grid)."""
    rng = random.Random(1)
    for _ in range(30):
        n = [rng.randint(1, 5) for _ in range(8)]
        good = [rng.randint(0, m) for m in n]
        at, values = kq.pooled(np.arange(8.0), np.array(good, float), np.array(n, float))
        assert (np.diff(values) > 0).all() and (np.diff(at) > 0).all()
        grid = np.unique([sum(good[a:b]) / sum(n[a:b]) for a in range(8) for b in range(a + 1, 9)])
        cost = np.zeros(len(grid))
        for g, m in zip(good, n, strict=True):
            cost = np.minimum.accumulate(cost) + g * (1 - grid) ** 2 + (m - g) * grid**2
        best = np.inf
        for cuts in range(2**7):  # every way to cut the eight cells into pools
            edges = [0, *[k + 1 for k in range(7) if cuts >> k & 1], 8]
            shares = [sum(good[a:b]) / sum(n[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            if len(shares) == len(values) and np.allclose(shares, values):
                best = sum(g * (1 - v) ** 2 + (m - g) * v**2 for a, b, v in zip(edges, edges[1:], shares, strict=False) for g, m in zip(good[a:b], n[a:b], strict=True))
                assert np.allclose(at, [np.average(range(a, b), weights=n[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
        assert best <= cost.min() + 1e-9


def test_held_out_accuracy(spark):
    """Documents never learned from: nearly all are judged as they are labelled, and good ones stay."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    rows = kq.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "quality").toPandas()
    assert len(rows) > 700 and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.9
    assert good.score.min() >= 0 and rows.score.max() <= 1
    assert np.mean([(good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean()]) > 0.99


def test_scores_ignore_everything_but_the_text(spark):
    docs, labels = tables(spark)
    held = docs.filter(kq.held_out(F.col("doc_id")))
    moved = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).withColumn("quality", F.lit(1))
    changed = labels.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(
        labels.join(held.select("doc_id"), "doc_id", "left_semi").withColumn("quality", F.lit(1) - F.col("quality"))
    )
    a, b = ({r["doc_id"]: r["score"] for r in kq.score_quality(d, x).collect()} for d, x in ((docs, labels), (moved.repartition(3), changed)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


@pytest.mark.parametrize("labelled", ["both", "one", "none"])
def test_odd_rows(spark, labelled):
    docs = frame(spark).withColumn("x0", F.lit("clash")).withColumn("y", F.lit(2)).withColumn("quality", F.lit(5))
    rows = {"both": [(i, i % 2, 0) for i in range(60)] + [(1000, 1, 0), (1000, 0, 0), (None, 1, 0), (3, 7, 0), (4, None, 0)], "one": [(1, 1, 0), (2, 1, 0)], "none": []}[labelled]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = kq.score_quality(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    if labelled != "both":
        assert {r["score"] for r in got} == {1.0 if labelled == "one" else 0.5}
    assert kq.score_quality(docs.limit(0), labels).collect() == []
