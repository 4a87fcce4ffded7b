"""Operators that go by blocks, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.operators import learning, staking
from veldrift.plans import markets, models

SMALL = "/root/testdata/sf0.001"


def test_cvar_takes_every_bet_and_blocks_change_nothing(spark):
    d = markets.rets(spark, SMALL).select("bet_id", "ret").cache()
    ret = [r.ret for r in d.orderBy("bet_id").collect()]
    n, reps = len(ret), 4
    picks = spark.range(n).withColumnRenamed("id", "i").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    picks = picks.withColumn("pick", F.pmod(F.xxhash64(F.lit(42), "rep", "i"), F.lit(n).cast("long"))).orderBy("rep", "i").collect()
    worst = {}
    for r in picks:
        log, peak, fall = worst.get(r.rep, (0.0, 0.0, 0.0))
        log += math.log(max(1 + 0.02 * ret[r.pick], 1e-12))
        peak = max(peak, log)
        worst[r.rep] = (log, peak, max(fall, peak - log))
    dd = sorted(1 - math.exp(-f) for _, _, f in worst.values())
    for block in (7, 10_000):
        got = staking.cvar_drawdown(d, 0.02, "bet_id", alpha=1.0, resamples=reps, block=block).first()
        assert abs(got.value_at_risk - dd[0]) < 1e-9 and abs(got.cvar - sum(dd) / reps) < 1e-9
    whole = staking.cvar_drawdown(d, 0.02, "bet_id", resamples=50).first()
    assert abs(markets.R.queries["cvar_drawdown"](spark, SMALL).first().cvar - whole.cvar) < 1e-9


def test_grid_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 3)), 0.01 * rng.normal(size=(40, 3)), np.tile([9.0, 9.0, 9.0], (12, 1)), [[50.0, 0.0, 0.0]]]) * [0.1, 20, 2]
    names = ("return", "rsi", "log_volume")
    b = spark.createDataFrame([(i, *map(float, r), float(i % 2)) for i, r in enumerate(x)], "i long, `return` double, rsi double, log_volume double, label double")
    a = b.filter("label = 1").drop("label")
    expected = set()
    for i in range(1, len(x), 2):
        gaps = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((g, j) for j, g in enumerate(gaps) if j != i)[:5]
        expected |= {(i, j, n + 1) for n, (_, j) in enumerate(order)}
    for all_pairs in (0, 10**6):
        assert {(r.i, r.j, r.n) for r in learning._neighbours(a, b, names, 5, all_pairs).collect()} == expected


def test_smote_query_takes_all_training_rows(spark):
    """All rows but the test's, under a label that few rows have."""
    d = learning.prepare(models.ind.add_labels(models.base(spark, SMALL), rise=0.05)).filter("part <> 'test'").groupBy("label").count().collect()
    counts = sorted(r["count"] for r in d)
    assert models.R.queries["smote"](spark, SMALL).count() == counts[1] - counts[0]


def test_growth_over_ranges_equals_runs_of_bets(spark):
    """Bets that lose all, null and single ones, and a null key; each key is one series however it is dealt out."""
    rng = np.random.default_rng(5)
    rows = [(k, int(i), float(x)) for k in ("a", None, "b") for i, x in enumerate(rng.choice([1.1, -1.0, 0.3], 3000))]
    rows += [("c", 0, -200.0), ("c", 1, 0.5), ("d", 0, None), ("e", 0, 0.1)]
    d = spark.createDataFrame(rows, "league string, bet_id long, ret double").repartition(3)
    got = {(r.league, r.fraction): (r.growth, r.max_drawdown) for r in staking.growth_and_drawdown(d, [0.01, 0.1], "bet_id", "league").collect()}
    assert len(got) == 12
    for k in ("a", None, "b", "c", "e"):
        for f in (0.01, 0.1):
            x = 1 + f * np.array([r[2] for r in rows if r[0] == k])
            log = np.cumsum(np.log(x[x > 0]))
            assert got[k, f][0] == (-1e20 if (x <= 0).any() else pytest.approx(log[-1] / len(x), abs=1e-12))
            assert got[k, f][1] == pytest.approx((1 - np.exp(log - np.maximum(np.maximum.accumulate(log), 0))).max(), abs=1e-9)
    plan = staking.growth_and_drawdown(d, [0.01], "bet_id", "league")._jdf.queryExecution().optimizedPlan().toString()
    assert "ret#" not in plan  # windows run over ranges, not over bets
