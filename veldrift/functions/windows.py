"""Trailing-window expressions over keyed series.

``full`` gives a value once a window holds ``n`` non-null rows, ``minp`` once it holds ``m``. Days are rows. All frames
of one series share one sort, so a plan has one exchange by key however many windows it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "ticker"
TIME = "timestamp"


def series(key: str = KEY, time: str = TIME) -> WindowSpec:
    return W.partitionBy(key).orderBy(time)


def trailing(n: int, key: str = KEY, time: str = TIME) -> WindowSpec:
    return series(key, time).rowsBetween(-(n - 1), 0)


def cumulative(key: str = KEY, time: str = TIME) -> WindowSpec:
    return series(key, time).rowsBetween(W.unboundedPreceding, 0)


def full(n: int, agg: Callable[[Column], Column], x: str, key: str = KEY, time: str = TIME) -> Column:
    return minp(n, n, agg, x, key=key, time=time)


def minp(n: int, m: int, agg: Callable[..., Column], *x: str, key: str = KEY, time: str = TIME) -> Column:
    """``agg`` of the columns over n rows, if m rows have them all."""
    w = trailing(n, key, time)
    whole = F.count(F.when(_all_set(*x), 1)).over(w)
    return F.when(whole >= m, agg(*[F.col(c) for c in x]).over(w))


def _all_set(*x: str) -> Column:
    out = F.col(x[0]).isNotNull()
    for c in x[1:]:
        out = out & F.col(c).isNotNull()
    return out


def lag(x: str, n: int = 1, key: str = KEY, time: str = TIME) -> Column:
    return F.lag(x, n).over(series(key, time))


def lead(x: str, n: int = 1, key: str = KEY, time: str = TIME) -> Column:
    return F.lead(x, n).over(series(key, time))


def change(x: str, n: int = 1) -> Column:
    """Relative change over n rows; null where the earlier value is null or 0."""
    return F.try_divide(F.col(x), lag(x, n)) - 1


def forward_fill(x: str, default: float = 0.0) -> Column:
    return F.coalesce(F.last(x, ignorenulls=True).over(cumulative()), F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def skew(x: str, w: WindowSpec, m: int) -> Column:
    """Bias-corrected skewness; 0 in a constant window, null under max(m, 3) rows."""
    n = F.count(x).over(w)
    g = F.when(F.min(x).over(w) == F.max(x).over(w), 0.0).otherwise(
        F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    )
    return F.when(n >= max(m, 3), g)


def kurtosis(x: str, w: WindowSpec, m: int) -> Column:
    """Bias-corrected excess kurtosis; -3 in a constant window, null under max(m, 4) rows."""
    n = F.count(x).over(w)
    g = F.when(F.min(x).over(w) == F.max(x).over(w), -3.0).otherwise(
        (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x).over(w) + 6)
    )
    return F.when(n >= max(m, 4), g)


def corr(x: str, y: str, n: int, m: int, key: str = KEY, time: str = TIME) -> Column:
    """Correlation over n rows if m have both; null where one of the columns is constant."""
    both = _all_set(x, y)
    a, b, at = F.when(both, F.col(x)), F.when(both, F.col(y)), trailing(n, key, time)
    r = F.try_divide(F.covar_pop(a, b).over(at), F.stddev_pop(a).over(at) * F.stddev_pop(b).over(at))
    flat = (F.min(a).over(at) == F.max(a).over(at)) | (F.min(b).over(at) == F.max(b).over(at))
    return F.when((F.count(a).over(at) >= m) & ~flat, r)
