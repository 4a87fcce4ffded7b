"""Search of parameters by densities of good and bad trials (tree-structured Parzen estimators).

After some random trials the best quarter are good and the others bad. Each parameter has a density of either, a mixture of
normals around the trials' values; candidates are drawn from the good one, and the one with the largest ratio of good to bad
is tried next. ``width`` trials are in flight at once, as Spark jobs of several threads; a trial's waiting neighbours count
as bad, so they are not proposed twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import written
from . import evaluation as ev
from . import learning


@dataclass(frozen=True)
class Number:
    """A number from ``low`` to ``high``; ``log``: by its logarithm, ``whole``: rounded."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self, value: float) -> float:
        a, b = (math.log(v) if self.log else v for v in (self.low, self.high))
        return ((math.log(value) if self.log else value) - a) / ((b - a) or 1.0)

    def value(self, place: float) -> float | int:
        a, b = (math.log(v) if self.log else v for v in (self.low, self.high))
        v = a + (b - a) * min(1.0, max(0.0, place))
        v = min(self.high, max(self.low, math.exp(v) if self.log else v))
        return round(v) if self.whole else v


Space = dict[str, Number | list]


def _mixture(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths on 0 to 1: a wide one of the whole range, and one of each trial as wide as its larger gap."""
    order = np.argsort(places)
    line = np.concatenate([[0.0], places[order], [1.0]])
    gaps = np.maximum(np.diff(line)[:-1], np.diff(line)[1:])
    return np.append(places[order], 0.5), np.append(np.clip(gaps, 1 / min(100, len(places) + 2), 1.0), 1.0)


def _density(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    c, s = _mixture(places)
    z = (x[:, None] - c) / s
    inside = np.array([math.erf((1 - m) / w / math.sqrt(2)) - math.erf(-m / w / math.sqrt(2)) for m, w in zip(c, s, strict=True)]) / 2
    return (np.exp(-z * z / 2) / (s * math.sqrt(2 * math.pi) * inside)).mean(axis=1)


def proposal(space: Space, trials: list[tuple[dict, float]], waiting: list[dict], rng: np.random.Generator, start: int = 5, draws: int = 24) -> dict:
    """The parameters to try next, after (parameters, score) of earlier trials; larger scores are better."""
    if len(trials) < start:
        return {k: s.value(rng.random()) if isinstance(s, Number) else s[rng.integers(len(s))] for k, s in space.items()}
    ranked = sorted(range(len(trials)), key=lambda i: (-trials[i][1], i))
    good = ranked[: max(2, math.ceil(len(trials) / 4))]
    chosen = [trials[i][0] for i in good], [trials[i][0] for i in ranked[len(good) :]] + waiting
    out = {}
    for k, s in space.items():
        if isinstance(s, Number):
            a, b = (np.array([s.place(p[k]) for p in group]) for group in chosen)
            c, wide = _mixture(a)
            pick = rng.integers(len(c), size=draws)
            x = np.clip(rng.normal(c[pick], wide[pick]), 0, 1)
            out[k] = s.value(float(x[np.argmax(_density(x, a) / _density(x, b))]))
        else:
            a, b = (np.array([1 + sum(p[k] == v for p in group) for v in s], float) for group in chosen)
            picks = rng.choice(len(s), size=draws, p=a / a.sum())
            out[k] = s[int(picks[np.argmax((a / a.sum() / (b / b.sum()))[picks])])]
    return out


def maximise(objective: Callable[[dict], float], space: Space, trials: int = 30, width: int = 4, seed: int = 42) -> list[tuple[dict, float]]:
    """(parameters, score) of every trial in the order proposed. A trial whose score is not a number counts as the worst.

    Trials are proposed and awaited ``width`` at a time, so a seed gives the same search however long each takes."""
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    with ThreadPoolExecutor(width) as pool:
        while len(done) < trials:
            asked: list[dict] = []
            for _ in range(min(width, trials - len(done))):
                asked.append(proposal(space, done, asked, rng))
            scores = list(pool.map(objective, asked))
            done += [(p, -math.inf if s is None or math.isnan(s) else s) for p, s in zip(asked, scores, strict=True)]
    return done


def search(d: DataFrame, space: Space, kind: str = "forest", trials: int = 30, folds: int = 5, width: int = 4, seed: int = 42) -> DataFrame:
    """(trial, parameters as text, auc, best): the mean walk-forward area of each trial of a model's parameters."""
    used = written(ev.walk_forward(d.filter("part <> 'test'").drop("part"), folds=folds), "folds")
    numbers = sorted(r.fold for r in used.select("fold").distinct().collect())  # a row for each fold

    def objective(params: dict) -> float:
        areas = []
        for f in numbers:
            fold = used.filter(F.col("fold") == f)
            model = learning.fit(fold.filter("part = 'train'"), kind, **params)
            areas.append(ev.auc(learning.with_p(model, fold.filter("part = 'test'")), "p", "label").first().auc)
        known = [a for a in areas if a is not None]
        return sum(known) / len(known) if known else math.nan

    found = maximise(inheritable_thread_target(d.sparkSession)(objective), space, trials, width, seed)
    best = max(range(len(found)), key=lambda i: (found[i][1], -i))
    rows = [(i, ", ".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in sorted(p.items())), float(s), i == best) for i, (p, s) in enumerate(found)]
    return d.sparkSession.createDataFrame(rows, "trial int, parameters string, auc double, best boolean")
