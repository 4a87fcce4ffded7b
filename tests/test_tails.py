"""Tail probabilities against integrals of their densities, and risk searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.functions import tails
from veldrift.operators import staking


def integral(f, start, n=400_000):
    s = (np.arange(n) + 0.5) / n
    return float((f(start + s / (1 - s)) / (1 - s) ** 2).sum() / n)


def t_density(k):
    c = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
    return lambda u: c * (1 + u * u / k) ** (-(k + 1) / 2)


def chi2_density(k):
    return lambda u: np.exp((k / 2 - 1) * np.log(u) - u / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))


def f_density(a, b):
    c = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b)
    return lambda u: np.exp(c + (a / 2 - 1) * np.log(u) - (a + b) / 2 * np.log(1 + a * u / b))


def test_tails_equal_their_integrals(spark):
    one = spark.range(1)
    cases, expected = [], []
    for t, k in ((0.0, 3), (1.5, 1), (-2.2, 10), (3.3, 500), (0.7, 40_000)):
        cases.append(tails.t_two_sided(F.lit(t), F.lit(float(k))))
        expected.append(2 * integral(t_density(k), abs(t)))
    for x, k in ((0.5, 2), (3.84, 1), (30.0, 12), (900.0, 1000), (1100.0, 1000)):
        cases.append(tails.chi2_tail(F.lit(x), F.lit(float(k))))
        expected.append(integral(chi2_density(k), x))
    for x, a, b in ((0.3, 2, 20), (3.5, 2, 20), (1.02, 50, 3000)):
        cases.append(tails.f_tail(F.lit(x), F.lit(float(a)), F.lit(float(b))))
        expected.append(integral(f_density(a, b), x))
    for z in (0.0, 1.96, 4.0):
        cases.append(tails.normal_two_sided(F.lit(z)))
        expected.append(math.erfc(z / math.sqrt(2)))
    got = one.select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert list(got) == pytest.approx(expected, abs=2e-6)
    r = one.select(tails.correlation_tail(F.lit(1.0), F.lit(5)).alias("a"), tails.correlation_tail(F.lit(0.3), F.lit(2)).alias("b")).first()
    assert tuple(r) == (0.0, None)


def test_the_constrained_fraction_is_the_least_of_a_fine_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(np.where(rng.random() < 0.52, 1.1, -1.0))) for k in ("a", "b") for i in range(200)]
    d = spark.createDataFrame(rows, "league string, bet_id long, ret double")
    got = {r.league: r for r in staking.risk_constrained(d, "bet_id", "league").collect()}

    def measures(x, f):
        log = np.cumsum(np.log(1 + f * x))
        return float(np.mean(np.log(1 + f * x))), float(np.max(1 - np.exp(log - np.maximum.accumulate(np.maximum(log, 0)))))

    for k in ("a", "b"):
        x = np.array([r[2] for r in rows if r[0] == k])
        grid = [0.005 + 0.145 * i / 29 for i in range(30)]
        best = max((measures(x, f)[0], -f) for f in grid)
        g, risk = measures(x, -best[1])
        score = lambda f: 0.5 * measures(x, f)[1] / risk - measures(x, f)[0] / abs(g)  # noqa: E731, B023
        least = min(score(0.005 + 0.145 * i / 20_000) for i in range(20_001))
        assert got[k].score <= least + 1e-4 and 0.005 <= got[k].fraction <= 0.15


def test_signal_portfolio_and_safe_share(spark):
    day = "cast('2024-01-01' as date)"
    bets = spark.range(4).selectExpr("id as bet_id", "'L' as league", f"{day} as date", "0.1D as ev", "id < 3 as bet_signal")
    got = {r.bet_id: r for r in staking.signal_portfolio(bets, 1000.0).collect()}
    assert sorted(got) == [0, 1, 2] and sum(r.weight for r in got.values()) == pytest.approx(1, abs=1e-6)
    assert all(r.stake == pytest.approx(r.weight * 1000 * staking.EXPOSURE) for r in got.values())
    with pytest.raises(ValueError):
        staking.signal_portfolio(bets, 1000.0, most=2)
    assert staking.signal_portfolio(bets.filter("not bet_signal"), 1000.0).count() == 0
    safe = staking.largest_safe_fraction(spark, 0.6, 2.0, n_sims=200, n_bets=50, steps=6).first()
    assert 0 < safe.share <= 1 and safe.p_dd30 <= 0.10
    assert staking.largest_safe_fraction(spark, 0.4, 2.0).first().share == 0.0


def test_signal_portfolio_of_many_signals(spark):
    """A thousand signals, unlike groups, one tiny edge that the cap holds: better than or as good as the optimiser on the
    driver, and the conditions of the optimum hold."""
    rng = np.random.default_rng(7)
    for n, tiny in ((1000, False), (30, False), (30, True)):
        e = 0.5 + 3 * rng.random(n)
        if tiny:
            e[0] = 0.001
        g = rng.integers(0, 4, n)
        rows = [(i, f"L{g[i]}", "2024-01-01", float(e[i]), True) for i in range(n)]
        bets = spark.createDataFrame(rows, "bet_id long, league string, date string, ev double, bet_signal boolean")
        got = {r.bet_id: r.weight for r in staking.signal_portfolio(bets, 1000.0).collect()}
        w = np.array([got[i] for i in range(n)])
        cap = max(0.4, 1 / n + 0.01)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= cap * (1 + 1e-8) and (w.max() > cap * (1 - 1e-9)) == tiny
        sd = e / 1.5
        cov = np.where(g[:, None] == g, 0.1, 0.0) * np.outer(sd, sd)
        np.fill_diagonal(cov, sd * sd)
        sharpe = lambda w: w @ e / np.sqrt(w @ cov @ w)  # noqa: E731, B023
        for _ in range(200):  # no step towards other weights within the bounds is better
            other = staking.project_simplex(w + rng.normal(size=n) * rng.choice([1e-4, 1e-2, 0.3]) / np.sqrt(n), cap)
            assert sharpe(other) <= sharpe(w) + 1e-9
