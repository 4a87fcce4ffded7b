"""The search by densities on a known surface, and over folds of a model."""

import math

import numpy as np

from veldrift.operators import tuning

SPACE = {"x": tuning.Number(-5, 5), "r": tuning.Number(1e-4, 1e2, log=True), "n": tuning.Number(1, 20, whole=True), "c": ["a", "b", "c"]}


def surface(p):
    return -((p["x"] - 2) ** 2) - (math.log10(p["r"]) + 1) ** 2 - ((p["n"] - 7) / 5) ** 2 - (p["c"] != "b")


def test_beats_as_many_random_trials():
    by_density, by_chance = [], []
    for seed in range(12):
        found = tuning.maximise(surface, SPACE, trials=40, width=4, seed=seed)
        assert len(found) == 40 and all(-5 <= p["x"] <= 5 and 1e-4 <= p["r"] <= 1e2 and p["n"] in range(1, 21) for p, _ in found)
        by_density.append(max(s for _, s in found))
        rng = np.random.default_rng(1000 + seed)
        by_chance.append(max(surface(tuning.proposal(SPACE, [], [], rng)) for _ in range(40)))
    assert np.mean(by_density) > np.mean(by_chance) and np.median(by_density) > np.median(by_chance)


def test_a_seed_gives_one_search():
    assert tuning.maximise(surface, SPACE, 12, 3, 5) == tuning.maximise(surface, SPACE, 12, 3, 5)
    assert tuning.maximise(lambda p: float("nan"), SPACE, 8)[-1][1] == -math.inf
    one = {"x": tuning.Number(3, 3), "c": ["only"]}
    assert all(p == {"x": 3, "c": "only"} for p, _ in tuning.maximise(lambda p: 0.0, one, 8))


def test_density_is_one_over_the_range():
    x = np.linspace(0, 1, 20_001)
    for places in (np.array([0.5]), np.array([0.0, 0.01, 1.0]), np.random.default_rng(0).random(30)):
        assert abs(np.trapezoid(tuning._density(x, places), x) - 1) < 1e-3
