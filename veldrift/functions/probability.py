"""Scalar probability functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_factorial(k: Column) -> Column:
    """ln k!; 0 for k up to 1."""
    return F.aggregate(F.when(k > 1, F.sequence(F.lit(2), k)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def poisson_pmf(k: Column, mu: Column) -> Column:
    """A point mass at 0 where mu is not positive."""
    safe = F.when(mu > 0, mu)
    return F.when(mu <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(-safe + k * F.log(safe) - log_factorial(k)))


def poisson_cdf(k: Column, mu: Column) -> Column:
    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + poisson_pmf(i, mu)))


def saturating(x: Column, k: float = 0.8) -> Column:
    """1 - exp(-x k), within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-x * k)))


def over_under(x: Column, threshold: float = 0.02, k: float = 1.0) -> Column:
    """The scalar form, which adds 0.01 to the threshold."""
    return saturating(F.abs(x) / (threshold + 0.01), k)


def bounded(base: float, parts: list[Column], lo: float = 0.05, hi: float = 0.95) -> Column:
    out = F.lit(base)
    for p in parts:
        out = out + p
    return F.greatest(F.lit(lo), F.least(F.lit(hi), out))


def normalised(m: Column) -> Column:
    """A map's values scaled to sum to 1; all alike if they sum to 0."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(m, lambda _, v: F.when(total > 0, v / total).otherwise(F.lit(1.0) / F.size(m)))


def blend(signal: Column, volatility: Column, rsi: Column, base: float = 0.5) -> Column:
    """0.4 of the rise's, 0.3 of the large move's and 0.3 of the combined probability, within 0.05 and 0.95."""
    r = (rsi - 50) / 50
    up = saturating(F.abs(signal) * (1 + F.abs(r)), 0.8)
    combined = bounded(base, [r * 0.1, volatility * -0.05])
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.4 * up + 0.3 * over_under(signal) + 0.3 * combined))


def applied(d: DataFrame) -> DataFrame:
    """Rows (k, mu) with the functions' values."""
    k, mu = F.col("k"), F.col("mu")
    return d.withColumns({"pmf": poisson_pmf(k, mu), "saturating": saturating(mu), "over_under": over_under(mu), "bounded": bounded(0.5, [k * 0.01])})
