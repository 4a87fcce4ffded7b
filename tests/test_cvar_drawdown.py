"""The bootstrap of drawdowns against numpy's, by one table of factors and by parts of them, and what it shuffles."""

import numpy as np
import pytest

from veldrift.operators import staking


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def by_numpy(ret, fraction, alpha, resamples):
    rng, dd = np.random.default_rng(3), []
    for _ in range(resamples):
        log = np.cumsum(np.log(np.maximum(1 + fraction * rng.choice(ret, len(ret)), 1e-12)))
        dd.append(1 - np.exp((log - np.maximum.accumulate(np.maximum(log, 0))).min()))
    at = np.quantile(dd, 1 - alpha)
    return at, np.mean([x for x in dd if x >= at])


@pytest.mark.parametrize("most", [1_000_000, 400])  # of 1,000 factors: one table, five parts
def test_drawdowns_are_those_of_resamples(spark, most):
    ret = np.random.default_rng(2).normal(0.1, 1.0, 1000)
    d = spark.createDataFrame([(float(x),) for x in ret], "ret double")
    got = staking.cvar_drawdown(d, 0.05, 0.1, resamples=400, block=500, most=most).first()
    again = staking.cvar_drawdown(d.repartition(3), 0.05, 0.1, resamples=400, block=500, most=most).first()
    assert tuple(got) == pytest.approx(tuple(again), abs=1e-12)  # tasks do not matter
    assert tuple(got) == pytest.approx(by_numpy(ret, 0.05, 0.1, 2000), abs=0.03)


def test_no_draw_is_shuffled(spark):
    d = spark.range(30_000).selectExpr("if(id * 7919 % 100 < 45, 0.2D + id % 40 / 10D, -1D) as ret")
    before = shuffled(spark)
    got = staking.cvar_drawdown(d, 0.02, resamples=20).first()
    assert 0 < got.value_at_risk <= got.cvar < 1
    assert shuffled(spark) - before < 5_000  # of 600,000 draws
