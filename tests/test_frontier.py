"""The efficient frontier against every choice of weights at their bounds."""

import itertools

import numpy as np
import pytest

from veldrift.operators import staking


def by_enumeration(mean, cov, target, cap):
    """The least variance over all ways to hold weights at 0 or the cap and solve for the rest."""
    n, best = len(mean), None
    for held in itertools.product((-1, 0, 1), repeat=n):
        held = np.array(held)
        free = np.flatnonzero(held == 0)
        w = np.where(held > 0, cap, 0.0)
        rows = np.stack([np.ones(n), mean])
        want = np.array([1.0, target]) - rows @ w
        kkt = np.block([[cov[np.ix_(free, free)], rows[:, free].T], [rows[:, free], np.zeros((2, 2))]])
        w[free] = np.linalg.lstsq(kkt, np.concatenate([-(cov @ w)[free], want]), rcond=None)[0][: len(free)]
        if abs(w.sum() - 1) < 1e-9 and abs(w @ mean - target) < 1e-9 and w.min() > -1e-9 and w.max() < cap + 1e-9 and (best is None or w @ cov @ w < best):
            best = w @ cov @ w
    return best


@pytest.mark.parametrize("n, cap", [(2, 1.0), (3, 0.4), (4, 0.5), (5, 0.4), (5, 1.0), (6, 0.3)])
def test_least_variance_at_every_target(n, cap):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a = rng.normal(size=(n + 2, n)) * 0.02
        mean, cov = rng.normal(size=n) * 0.001, np.cov(a.T)
        if seed == 3:
            mean[:2] = mean[0]  # equal means
        limit = max(cap, 1 / n + 0.01)
        got = {round(r.target, 12): r for r in staking.frontier(mean, cov, 9, cap).itertuples()}
        for target in np.linspace(mean.min(), mean.max(), 9):
            want = by_enumeration(mean, cov, target, limit)
            assert (want is None) == (round(target, 12) not in got), target
            if want is not None:
                r = got[round(target, 12)]
                w = np.array(r.weights)
                assert abs(w @ mean - target) < 1e-9 and abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= limit + 1e-12
                assert r.volatility**2 <= want * (1 + 1e-6) + 1e-15


def test_one_asset_and_no_spread():
    assert staking.frontier(np.array([0.1]), np.eye(1)).empty
    same = staking.frontier(np.full(3, 0.01), np.diag([1.0, 2.0, 4.0]), 2, 1.0)
    assert np.allclose(same.weights[0], np.array([4, 2, 1]) / 7)
