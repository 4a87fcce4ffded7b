"""Tail probabilities of the t, F, chi-squared and normal laws as column expressions, for statistics of a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients (g = 7) of the gamma function.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Terms of series and fractions; they converge in some multiples of the root of the degrees of freedom.
TERMS = 3000
#: Degrees of freedom from which t is taken as normal, to 1e-6.
NORMAL_FROM = 100_000
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0."""
    y = x - 1
    total = reduce(lambda a, k: a + F.lit(LANCZOS[k]) / (y + k), range(1, 9), F.lit(LANCZOS[0]))
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(total)


def _let(values: dict[str, Column], use) -> Column:
    """``use`` of a struct of values that are computed once."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), use)[0]


def _kept(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction from there on."""

    def at(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        steps = F.sequence(F.lit(1), F.lit(TERMS))
        term = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        below = F.aggregate(steps, term, lambda c, i: F.struct((c["t"] * x / (a + i)).alias("t"), (c["s"] + c["t"] * x / (a + i)).alias("s")), lambda c: 1 - front * c["s"])
        d0 = 1 / _kept(x + 1 - a)
        start = F.struct(F.lit(1 / TINY).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(s: Column, i: Column) -> Column:
            return _lentz(s, -i * (i - a), x + 2 * i + 1 - a)

        above = F.aggregate(steps, start, step, lambda s: front * s["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, below).otherwise(above)

    return _let({"a": a, "x": x}, at)


def _lentz(s: Column, over: Column, under: Column) -> Column:
    """A step of the modified Lentz method for a continued fraction."""
    return F.transform(
        F.array(F.struct((1 / _kept(under + over * s["d"])).alias("d"), _kept(under + over / s["c"]).alias("c"))),
        lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")),
    )[0]


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        d0 = 1 / _kept(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(s: Column, i: Column) -> Column:
            even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
            odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
            return _lentz(_lentz(s, even, F.lit(1.0)), odd, F.lit(1.0))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["h"])

    def at(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        return (
            F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a)
            .otherwise(1 - front * fraction(b, a, 1 - x) / b)
        )

    return _let({"a": a, "b": b, "x": x}, at)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return gamma_tail(F.lit(0.5), z * z / 2)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|)."""
    return F.when(dof > NORMAL_FROM, normal_two_sided(t)).otherwise(beta_share(dof / 2, F.lit(0.5), dof / (dof + t * t)))


def f_tail(f: Column, between: Column, within: Column) -> Column:
    """P(F >= f)."""
    share = beta_share(within / 2, between / 2, within / (within + between * f))
    return F.when(within > NORMAL_FROM, gamma_tail(between / 2, between * f / 2)).otherwise(share)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X >= x)."""
    return gamma_tail(dof / 2, x / 2)


def correlation_tail(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs by Student's t; 0 for perfect ones, null below three pairs."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, n - 2))
