import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.operators import evaluation, staking, trading

DAY = datetime.date(2024, 1, 1)


def frame(spark, prices, signals, ticker="A"):
    rows = [(ticker, DAY + datetime.timedelta(i), float(p), s) for i, (p, s) in enumerate(zip(prices, signals, strict=True))]
    return spark.createDataFrame(rows, "ticker string, timestamp date, close double, signal string")


def loop(prices, signals, cost, capital=10_000.0):
    cash, entry, out, trades = capital, None, [], 0
    for p, s in zip(prices, signals, strict=True):
        if s == "BUY" and entry is None:
            entry, trades = p * (1 + cost), trades + 1
        if s == "SELL" and entry is not None:
            cash, entry = cash * p * (1 - cost) / entry, None
            out.append(cash)
        else:
            out.append(cash if entry is None else cash * p / entry)
    return out, trades


def test_always_long(spark):
    r = trading.backtest(frame(spark, [100, 110, 105, 115], ["BUY"] * 4), ["ticker"]).first()
    assert round(r.sharpe, 3) == 9.591 and abs(r.total_return - 0.15) < 1e-12 and r.n_trades == 1


def test_costs_of_a_round_trip(spark):
    r = trading.backtest(frame(spark, [100, 110], ["BUY", "SELL"]), ["ticker"], 0.001, 0.001).first()
    assert abs(r.final_equity - 10_000 * (110 / 100.2) * 0.998) < 1e-6


def test_equity_equals_a_loop(spark):
    rng = random.Random(3)
    prices = [100.0]
    for _ in range(299):
        prices.append(prices[-1] * (1 + rng.gauss(0, 0.02)))
    signals = [rng.choice(["BUY", "SELL", "HOLD", "HOLD"]) for _ in prices]
    expected, trades = loop(prices, signals, 0.0015)
    got = trading.equity_curve(frame(spark, prices, signals), ["ticker"], 0.001, 0.0005).orderBy("timestamp").collect()
    np.testing.assert_allclose([r.equity for r in got], expected, rtol=1e-12)
    assert sum(r.entered for r in got) == trades


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError):
        trading.check_threshold(0.5)
    with pytest.raises(ValueError):
        trading.equity_curve(frame(spark, [1], ["BUY"]), ["ticker"], 0.6, 0.6)


def test_kelly(spark):
    d = spark.createDataFrame([(0.6, 2.0, "ALTA"), (0.6, 2.0, "BAJA"), (0.3, 2.0, "ALTA"), (0.9, 1.0, "ALTA"), (0.99, 5.0, "MEDIA")], "p double, o double, c string")
    got = [r[0] for r in d.select(staking.kelly_pct(F.col("p"), F.col("o"), F.col("c"))).collect()]
    assert got == pytest.approx([0.02, 0.01, 0.0, 0.0, 0.03])


def test_string_wins_and_bad_odds(spark):
    d = spark.createDataFrame([("True", 2.0), ("no", 3.0), ("1", 1.5)], "won string, odds_market double")
    assert [r.ret for r in staking.bet_returns(d).collect()] == [1.0, -1.0, 0.5]
    bad = spark.createDataFrame([("yes", 1.0)], "won string, odds_market double")
    with pytest.raises(Exception, match="odds must be over 1"):
        staking.bet_returns(bad).collect()


def test_bankroll_after_a_wipe_out(spark):
    d = spark.createDataFrame([("k", i, r) for i, r in enumerate([1.0, -1.0, 1.0, -0.5])], "k string, i int, ret double")
    got = [r.bankroll for r in staking.trajectory(d, 1.0, "i", "k").orderBy("i").collect()]
    np.testing.assert_allclose(got, [2000, 1e-12, 2e-12, 1e-12], rtol=1e-9)


def test_bankroll_over_many_bets_keeps_its_digits(spark):
    d = spark.range(200_000).selectExpr("'k' as k", "id as i", "if(id % 3 = 0, -0.7D, 0.4D + id % 7 / 13D) as ret")
    logs = [math.log(1 + 0.01 * (-0.7 if i % 3 == 0 else 0.4 + i % 7 / 13)) for i in range(200_000)]
    last = staking.trajectory(d, 0.01, "i", "k").orderBy(F.desc("i")).first()
    assert abs(math.log(last.bankroll) - math.log(1000) - math.fsum(logs)) < 5e-13


def test_logarithm_of_nothing_as_sql_has_it(spark):
    from veldrift.plans.markets import _ln

    d = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in d.select(_ln(F.col("x"))).collect()] == [-math.inf, 0.0, math.inf, None]


def test_ruin_does_not_depend_on_partitions(spark):
    a = staking.ruin(spark, 0.5, 2.0, 0.2, n_sims=200, n_bets=50, parts=2).first()
    b = staking.ruin(spark, 0.5, 2.0, 0.2, n_sims=200, n_bets=50, parts=7).first()
    assert tuple(a) == pytest.approx(tuple(b)) and a.p_ruin > 0.5
    assert staking.ruin(spark, 0.0, 2.0, 0.2).first().p_ruin == 0


def test_max_sharpe_weights():
    cov = np.diag([0.04, 0.01, 0.09])
    w = staking.max_sharpe(np.array([0.1, 0.1, 0.1]), cov, cap=0.9)
    expected = (1 / np.diag(cov)) / (1 / np.diag(cov)).sum()
    assert abs(w.sum() - 1) < 1e-6 and np.abs(w - expected).max() < 0.03
    assert staking.max_sharpe(np.array([0.1, 0.1, 0.1]), cov, cap=0.4).max() <= 0.4 + 1e-9
    assert staking.max_sharpe(np.array([-1.0, -1.0]), np.eye(2)).tolist() == [0.5, 0.5]


def test_purged_folds_as_is(spark):
    d = spark.createDataFrame([("A", i) for i in range(100)], "ticker string, timestamp int")
    got = evaluation.purged_folds(d, as_is=True).groupBy("fold", "part").count().collect()
    assert {(r.fold, r.part): r["count"] for r in got} == {(4, "test"): 14, (4, "train"): 80}


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (None, 1)], "p double, y int")
    pairs = [(a, b) for a in (0.4, 0.8) for b in (0.1, 0.4, 0.8)]
    expected = sum(1 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
    assert evaluation.auc(d).first().auc == pytest.approx(expected)


def test_conformal_coverage(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 4))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(4, p=q)) for q in p]
    d = spark.createDataFrame([(q.tolist(), t, i < 400) for i, (q, t) in enumerate(zip(p, y, strict=True))], "probs array<double>, y int, cal boolean")
    for method in ("lac", "aps"):
        sizes = []
        for alpha in (0.3, 0.1):
            c = evaluation.coverage(evaluation.conformal(d.filter("cal"), d.filter("not cal"), alpha, method)).first()
            assert c.coverage > 1 - alpha - 0.12
            sizes.append(c.mean_size)
        assert sizes[0] < sizes[1]
