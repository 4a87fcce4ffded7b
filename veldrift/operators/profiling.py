"""Data profiling, quality findings, statistical tests and drift.

Every operator is one or a few aggregations. Column lists come from the schema; values never reach the driver. Tests
give the statistic and its p-value.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.prefix import running_sum, written
from ..functions.inversions import discordant
from ..functions.quantiles import percentiles
from ..functions.tails import chi2_tail, correlation_tail, f_tail, normal_two_sided, t_two_sided


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def textual(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string"]


def _long(wide: DataFrame, names: Iterable[str], fields: list[str]) -> DataFrame:
    """One wide row of <column>__<field> to a row per column."""
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def quality(df: DataFrame) -> DataFrame:
    """column, rows, nulls, null_pct, unique, cardinality_pct, constant, zeros_pct, negatives_pct; in one pass."""
    aggs, nums = [], set(numeric(df))
    n = F.count(F.lit(1))
    for c in df.columns:
        x = F.col(c)
        share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
        aggs += [
            n.alias(f"{c}__rows"), F.sum(x.isNull().cast("long")).alias(f"{c}__nulls"), share(x.isNull()).alias(f"{c}__null_pct"),
            F.countDistinct(c).alias(f"{c}__unique"),
            (share(x == 0) if c in nums else F.lit(None).cast("double")).alias(f"{c}__zeros_pct"),
            (share(x < 0) if c in nums else F.lit(None).cast("double")).alias(f"{c}__negatives_pct"),
        ]
    out = _long(df.agg(*aggs), df.columns, ["rows", "nulls", "null_pct", "unique", "zeros_pct", "negatives_pct"])
    return out.withColumns({"cardinality_pct": F.round(F.try_divide(F.col("unique"), F.col("rows")), 4), "constant": F.col("unique") <= 1})


def duplicates(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeated rows."""
    return df.groupBy(*df.columns).count().agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("count") - F.count(F.lit(1))).alias("repeated_rows"))


def findings(df: DataFrame, target: str | None = None, cardinality: float = 0.5, missing: float = 0.3, factor: float = 1.5, leak: float = 0.95) -> DataFrame:
    """Constant, high-cardinality, high-missing, outlier and leakage findings: (column, kind, value)."""
    q = quality(df)
    text = textual(df)
    out = q.filter("unique <= 1").select("column", F.lit("constant").alias("kind"), F.col("unique").cast("double").alias("value"))
    ratio = F.try_divide(F.col("unique"), F.col("rows"))
    out = out.unionByName(q.filter(F.col("column").isin(text) & (ratio > cardinality)).select("column", F.lit("high_cardinality").alias("kind"), ratio.alias("value")))
    gone = F.try_divide(F.col("nulls"), F.col("rows"))
    out = out.unionByName(q.filter(gone > missing).select("column", F.lit("high_missing").alias("kind"), gone.alias("value")))
    out = out.unionByName(outliers(df, factor=factor).filter("n_outliers > 0").select("column", F.lit("outliers").alias("kind"), F.col("n_outliers").cast("double").alias("value")))
    if target:
        out = out.unionByName(correlations(df, [(c, target) for c in numeric(df) if c != target]).filter(F.abs("r") >= leak).select(F.col("a").alias("column"), F.lit("leakage_suspect").alias("kind"), F.col("r").alias("value")))
    return out


def outliers(df: DataFrame, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """column, lower, upper, n_outliers, fraction. Columns without spread have no outliers."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"method must be iqr or zscore, not {method!r}")
    names = numeric(df)
    if method == "iqr":
        quartiles = percentiles(df, [F.col(c) for c in names], [0.25, 0.75])
        cuts = [(None, None, False) if a is None else (a - (b - a) * factor, b + (b - a) * factor, b > a) for a, b in quartiles]
    else:
        both = df.agg(*[f(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # one row
        at = [(both[f"m{i}"], both[f"s{i}"]) for i in range(len(names))]
        cuts = [(None, None, False) if s is None else (m - s * factor, m + s * factor, s * factor > 0) for m, s in at]
    aggs = []
    for c, (lower, upper, spread) in zip(names, cuts, strict=True):
        lo, hi = F.lit(lower).cast("double"), F.lit(upper).cast("double")
        out = F.lit(spread) & ((F.col(c) < lo) | (F.col(c) > hi))
        aggs += [lo.alias(f"{c}__lower"), hi.alias(f"{c}__upper"), F.sum(F.when(out, 1).otherwise(0)).cast("long").alias(f"{c}__n_outliers"), F.count(c).alias(f"{c}__n")]
    wide = df.select(*[F.col(c) for c in names]).agg(*aggs)
    return _long(wide, names, ["lower", "upper", "n_outliers", "n"]).withColumn("fraction", F.round(F.try_divide(F.col("n_outliers"), F.col("n")), 4)).drop("n")


def outlier_rows(df: DataFrame, x: str, key: list[str], factor: float = 3.0) -> DataFrame:
    """Keys and values of rows over ``factor`` population standard deviations from the mean."""
    stats = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", z).filter(F.abs("z") > factor).select(*key, x, "z")


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's r of each pair of columns, over the rows that have both: (a, b, r), in one pass."""
    def r(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    wide = df.agg(*[r(a, b).alias(f"p{i}__r") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}__r").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def correlated_pairs(df: DataFrame, names: list[str], threshold: float = 0.9) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return correlations(df, pairs).filter(F.abs("r") >= threshold)


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n, mean, sd, min, quartiles, max, bias-corrected skew and excess kurtosis."""
    aggs = []
    quartiles = percentiles(df, [F.col(c) for c in names], [0.25, 0.5, 0.75])
    for c, three in zip(names, quartiles, strict=True):
        n = F.count(c)
        q = [F.lit(v).cast("double") for v in three]
        skew = F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
        kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(c) + 6))
        fields = {"n": n, "mean": F.avg(c), "sd": F.stddev_samp(c), "min": F.min(c).cast("double"), "q1": q[0], "median": q[1], "q3": q[2], "max": F.max(c).cast("double"), "skew": skew, "kurtosis": kurt}
        aggs += [v.alias(f"{c}__{k}") for k, v in fields.items()]
    return _long(df.agg(*aggs), names, ["n", "mean", "sd", "min", "q1", "median", "q3", "max", "skew", "kurtosis"])


def imputation(df: DataFrame) -> DataFrame:
    """How to fill each column that has nulls, by type and share of nulls."""
    nums = numeric(df)
    gone = F.try_divide(F.col("nulls"), F.col("rows"))
    return quality(df).filter("nulls > 0").select(
        "column", gone.alias("null_ratio"),
        F.when(F.col("column").isin(nums), F.when(gone < 0.05, "median").when(gone < 0.30, "model").otherwise("drop or flag"))
        .otherwise(F.when(gone < 0.10, "mode").otherwise("missing category")).alias("suggestion"),
    )


def schema_check(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, expected, found) of each difference; absent columns are ``missing`` and unexpected ones ``extra``."""
    found = dict(df.dtypes)
    out = [(c, t, found.get(c, "missing")) for c, t in expected.items() if found.get(c) != t]
    return out + [(c, "extra", t) for c, t in found.items() if c not in expected]


def histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Counts of equal-width bins from the least to the largest value, the last bin closed; empty bins are absent."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int"), F.lit(bins - 1)))
    return df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, x: str, k: int) -> DataFrame:
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(x)).limit(k)


# Ranks


def average_ranks(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """Ranks with ties at their mean: counts by value are numbered, then joined; rows never meet in one task."""
    counts = df.groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(counts, x, "_n", "_upto")
    ranks = upto.select(x, F.col("_n").alias("_ties"), (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, x)


# Tests


def normality(df: DataFrame, x: str) -> DataFrame:
    """D'Agostino and Pearson's K2 of skewness and kurtosis, its p-value, and whether that is over 0.05."""
    s = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("b1"), (F.kurtosis(x) + 3).alias("b2"))
    n = F.col("n")
    y = F.col("b1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    s = s.withColumns({"_y": y, "_w2": w2})
    z1 = F.asinh(F.col("_y") / F.sqrt(2 / (F.col("_w2") - 1))) / F.sqrt(F.log(F.sqrt("_w2")))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    std = (F.col("b2") - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + std * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), 1 / 3)) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return s.select(k2.alias("statistic"), F.exp(-k2 / 2).alias("pvalue"), (F.exp(-k2 / 2) > 0.05).alias("normal"))


def t_test(df: DataFrame, group: str, x: str, a: str, b: str, equal_var: bool = True) -> DataFrame:
    """Student's or Welch's t of two groups, its degrees of freedom and two-sided p-value, and Cohen's d with its size."""
    at = lambda g, agg: agg(F.when(F.col(group) == g, F.col(x)))
    s = df.agg(*[at(g, f).alias(f"{k}{i}") for i, g in ((1, a), (2, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    se1, se2 = v1 / n1, v2 / n2
    t = (F.col("m1") - F.col("m2")) / (F.sqrt(pooled * (1 / n1 + 1 / n2)) if equal_var else F.sqrt(se1 + se2))
    dof = (n1 + n2 - 2).cast("double") if equal_var else (se1 + se2) * (se1 + se2) / (se1 * se1 / (n1 - 1) + se2 * se2 / (n2 - 1))
    d = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / F.sqrt(pooled)).otherwise(0.0)
    size = F.when(F.abs(d) < 0.2, "small").when(F.abs(d) < 0.5, "medium").when(F.abs(d) < 0.8, "large").otherwise("very large")
    s = s.select(t.alias("statistic"), dof.alias("dof"), d.alias("cohens_d"), size.alias("effect"))
    return s.withColumn("pvalue", t_two_sided(F.col("statistic"), F.col("dof")))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    s = df.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("statistic"), (F.count(d) - 1).alias("dof"))
    return s.withColumn("pvalue", t_two_sided(F.col("statistic"), F.col("dof")))


def rank_tests(df: DataFrame, group: str, x: str) -> DataFrame:
    """Kruskal-Wallis H of all groups with tie correction."""
    d = df.select(group, x).filter(F.col(x).isNotNull() & F.col(group).isNotNull())
    r = average_ranks(d, x)
    sums = r.groupBy(group).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"))
    ties = d.groupBy(x).count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t"), F.sum("count").alias("N"))
    h = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(ties))
    n = F.col("N")
    value = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return _chi2(h.select(value.alias("statistic"), (F.col("k") - 1).alias("dof")))


def _chi2(s: DataFrame) -> DataFrame:
    """A row of statistic and dof with the p-value of the chi-squared law."""
    return s.withColumn("pvalue", F.when(F.col("dof") > 0, chi2_tail(F.col("statistic"), F.col("dof"))))


def mann_whitney(df: DataFrame, group: str, x: str, a: str, b: str) -> DataFrame:
    """U of the first group, and a two-sided p-value by the normal law with tie and continuity correction."""
    d = df.select(group, x).filter(F.col(x).isNotNull() & F.col(group).isin(a, b))
    r = average_ranks(d, x).groupBy(F.lit(1)).agg(
        F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("s"), F.sum((F.col(group) == a).cast("long")).alias("n1"), F.sum((F.col(group) == b).cast("long")).alias("n2")
    )
    ties = d.groupBy(x).count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t"))
    s = r.crossJoin(F.broadcast(ties))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("s") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return s.select(u.alias("statistic"), F.least(normal_two_sided(F.greatest(z, F.lit(0.0))), F.lit(1.0)).alias("pvalue"))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """F of one-way analysis of variance and its degrees of freedom."""
    g = df.filter(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    s = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    between = F.col("q") - F.col("t") * F.col("t") / F.col("N")
    f = (between / (F.col("k") - 1)) / (F.col("w") / (F.col("N") - F.col("k")))
    s = s.select(f.alias("statistic"), (F.col("k") - 1).alias("dof_between"), (F.col("N") - F.col("k")).alias("dof_within"))
    return s.withColumn("pvalue", f_tail(F.col("statistic"), F.col("dof_between"), F.col("dof_within")))


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared of a contingency table, its degrees of freedom and p-value; with Yates' correction on two by two.

    Only cells that occur are read: the sum of o^2 / e over them, less the number of rows, is the statistic. On two by
    two all four gaps are alike, and the margins give the rest.
    """
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = t.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = t.groupBy("b").agg(F.sum("o").alias("cb"))
    sums = rows.agg(F.sum("ra").alias("n"), F.count(F.lit(1)).alias("ka"), F.sum(1 / F.col("ra")).alias("ia"))
    sums = sums.crossJoin(cols.agg(F.count(F.lit(1)).alias("kb"), F.sum(1 / F.col("cb")).alias("ib")))  # one row each
    n = F.col("n")
    cells = t.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q"), F.first(F.struct("o", "ra", "cb")).alias("one")
    )
    s = cells.crossJoin(sums)
    gap = F.abs(F.col("one.o") - F.col("one.ra") * F.col("one.cb") / n)
    left = gap - F.least(F.lit(0.5), gap)
    value = F.when((F.col("ka") == 2) & (F.col("kb") == 2), left * left * n * F.col("ia") * F.col("ib")).otherwise(n * (F.col("q") - 1))
    return _chi2(s.select(value.alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof")))


def chi2_fit(df: DataFrame, x: str) -> DataFrame:
    """Chi-squared of a column's counts against equal frequencies."""
    return chi2_expected(df, x, None)


def chi2_expected(df: DataFrame, x: str, shares: dict[object, float] | None) -> DataFrame:
    """Chi-squared of a column's counts against expected shares of its values, or equal ones. Values without a share are
    left out; one that does not occur counts 0."""
    c = df.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("o"))
    if shares is None:
        s = c.agg(F.sum("o").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("o") * F.col("o")).alias("q"))
        value = F.col("q") * F.col("k") / F.col("n") - F.col("n")
    else:
        e = df.sparkSession.createDataFrame(list(shares.items()), f"x {dict(c.dtypes)['x']}, share double")
        c = e.join(c, "x", "left").withColumn("o", F.coalesce("o", F.lit(0)))
        s = c.agg(F.sum("o").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("o") * F.col("o") / F.col("share")).alias("q"), F.sum("share").alias("all"))
        value = F.col("q") * F.col("all") / F.col("n") - F.col("n")
    return _chi2(s.select(value.alias("statistic"), (F.col("k") - 1).alias("dof")))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's r of the rows that have both, and its two-sided p-value."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return _correlation(d.agg(F.corr(a, b).alias("statistic"), F.count(F.lit(1)).alias("n")))


def _correlation(s: DataFrame) -> DataFrame:
    return s.withColumn("pvalue", correlation_tail(F.col("statistic"), F.col("n")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_ranks(average_ranks(d, a, "_ra").drop("_ties"), b, "_rb")
    return _correlation(r.agg(F.corr("_ra", "_rb").alias("statistic"), F.count(F.lit(1)).alias("n")))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b, and its p-value by the normal law with the variance of ties. Pairs in opposite order are counted by
    ``inversions.discordant`` over the different pairs of values; pairs in the same order are what neither they nor the ties
    take of all pairs."""
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    c = written(c, "values")
    opposite = discordant(c)

    def ties(of: str) -> DataFrame:
        m = F.col("m").cast("double")
        return c.groupBy(of).agg(F.sum("n").alias("m")).agg(
            F.sum(m * (m - 1) / 2).alias(f"t{of}"), F.sum(m * (m - 1) * (m - 2)).alias(f"u{of}"), F.sum(m * (m - 1) * (2 * m + 5)).alias(f"v{of}"), F.sum("m").alias(f"n{of}")
        )

    both = F.col("n").cast("double")
    d = ties("x").crossJoin(ties("y")).crossJoin(c.agg(F.sum(both * (both - 1) / 2).alias("t"))).withColumn("n", F.col("nx"))
    d = d.withColumn("s", F.col("n").cast("double") * (F.col("n") - 1) / 2 - F.col("tx") - F.col("ty") + F.col("t") - 2.0 * F.lit(float(opposite)))
    n = F.col("n").cast("double")
    pairs = n * (n - 1)
    variance = (pairs * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18 + 2 * F.col("tx") * F.col("ty") / pairs + F.col("ux") * F.col("uy") / (9 * pairs * (n - 2))
    tau = F.col("s") / F.sqrt((pairs / 2 - F.col("tx")) * (pairs / 2 - F.col("ty")))
    return d.select(tau.alias("statistic"), "n", normal_two_sided(F.col("s") / F.sqrt(variance)).alias("pvalue"))


# Drift


def psi(df: DataFrame, names: list[str], reference: Column, current: Column, bins: int = 10) -> DataFrame:
    """Population stability index of each column: (column, psi, verdict). Bins are the reference's deciles, closed to
    the right; shares are smoothed by 1e-6."""
    deciles = percentiles(df, [F.when(reference, F.col(c)) for c in names], [k / bins for k in range(bins + 1)])
    edges = [F.array(*[F.lit(e) for e in dict.fromkeys(v)]).cast("array<double>") if v[0] is not None else F.array().cast("array<double>") for v in deciles]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), e.alias("e")) for c, e in zip(names, edges, strict=True)])
    d = df.withColumns({"_ref": reference, "_cur": current}).filter("_ref or _cur")
    d = d.select("_ref", "_cur", F.explode(rows).alias("r")).filter("r.x is not null")
    inner = F.slice(F.col("r.e"), F.lit(2), F.greatest(F.size("r.e") - 2, F.lit(0)))
    d = d.select("_ref", "_cur", "r.column", F.size(F.filter(inner, lambda e: e < F.col("r.x"))).alias("bin"), (F.size("r.e") - 1).alias("k"))
    counts = d.groupBy("column", "bin").agg(F.sum(F.col("_ref").cast("long")).alias("nr"), F.sum(F.col("_cur").cast("long")).alias("nc"), F.first("k").alias("k"))
    both = W.partitionBy("column")
    p, q = F.col("nr") / F.sum("nr").over(both) + 1e-6, F.col("nc") / F.sum("nc").over(both) + 1e-6
    out = counts.withColumn("part", (q - p) * F.log(q / p)).groupBy("column").agg(F.when(F.first("k") >= 1, F.sum("part")).otherwise(0.0).alias("psi"))
    return out.withColumn("verdict", F.when(F.col("psi") >= 0.25, "significant").when(F.col("psi") >= 0.10, "moderate").otherwise("none"))


def mean_shift(df: DataFrame, names: list[str], reference: Column, current: Column) -> DataFrame:
    """Mean over columns of (mean difference)^2 / (sum of population variances), exp(-it), and whether under 0.05."""
    parts = []
    for c in sorted(names):
        r, n = F.when(reference, F.col(c)), F.when(current, F.col(c))
        parts.append((F.avg(r) - F.avg(n)) * (F.avg(r) - F.avg(n)) / (F.var_pop(r) + 1e-12 + F.var_pop(n) + 1e-12))
    shift = reduce(lambda a, b: a + b, parts) / len(parts)
    return df.agg(shift.alias("mean_shift")).withColumns({"pvalue": F.exp(-F.col("mean_shift")), "drift": F.exp(-F.col("mean_shift")) < 0.05})


def ks(df: DataFrame, x: str, reference: Column, current: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p-value. Counts are by value, then cumulated."""
    c = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.sum(reference.cast("long")).alias("r"), F.sum(current.cast("long")).alias("c"))
    c = written(c, "values")  # read three times
    c = running_sum(running_sum(c, "x", "r", "_r"), "x", "c", "_c")
    totals = c.agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    gap = F.abs(F.col("_r") / F.col("n") - F.col("_c") / F.col("m"))
    s = c.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"))
    en = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    lam = (en + 0.12 + 0.11 / en) * F.col("statistic")
    tail = reduce(lambda a, k: a + 2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam), range(1, 8), F.lit(0.0))
    return s.select("statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(lam < 0.3, 1.0).otherwise(tail))).alias("pvalue"))


def frequency_shift(df: DataFrame, x: str, reference: Column, current: Column) -> DataFrame:
    """Counts of each category in both parts (0 where absent), from an outer join."""
    r = df.filter(reference).groupBy(x).agg(F.count(F.lit(1)).alias("n_reference"))
    c = df.filter(current).groupBy(x).agg(F.count(F.lit(1)).alias("n_current"))
    return r.join(c, x, "full").select(x, F.coalesce("n_reference", F.lit(0)).alias("n_reference"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def column_drift(df: DataFrame, numbers: list[str], texts: list[str], reference: Column, current: Column, least: int = 5) -> DataFrame:
    """Drift of each column between two parts: (column, test, statistic, pvalue, drift). Numbers by Kolmogorov and
    Smirnov, texts by chi-squared of part against value; a column with fewer than ``least`` values in a part is left
    out. Drift is a p-value under 0.05."""
    parts = df.withColumn("_part", F.when(reference, "reference").when(current, "current")).filter("_part is not null")
    enough = parts.agg(*[F.count(F.when(F.col("_part") == p, F.col(c))).alias(f"{c}__{p}") for c in [*numbers, *texts] for p in ("reference", "current")]).first()
    out = []
    for c in [*numbers, *texts]:
        if min(enough[f"{c}__reference"], enough[f"{c}__current"]) < least:
            continue
        test = ks(parts, c, F.col("_part") == "reference", F.col("_part") == "current") if c in numbers else chi2_independence(parts, "_part", c)
        out.append(test.select(F.lit(c).alias("column"), F.lit("ks" if c in numbers else "chi2").alias("test"), "statistic", "pvalue", (F.col("pvalue") < 0.05).alias("drift")))
    empty = df.sparkSession.createDataFrame([], "column string, test string, statistic double, pvalue double, drift boolean")
    return reduce(DataFrame.unionByName, out, empty)


def skewed(df: DataFrame, names: list[str], limit: float = 1.0) -> DataFrame:
    """(column, skew) of the columns whose bias-corrected skewness is beyond ``limit`` either way; by one aggregation."""
    n = lambda c: F.count(c).cast("double")
    skew = lambda c: F.when(n(c) > 2, F.skewness(c) * F.sqrt(n(c) * (n(c) - 1)) / F.nullif(n(c) - 2, F.lit(0.0)))
    return _long(df.agg(*[skew(c).alias(f"{c}__skew") for c in names]), names, ["skew"]).filter(F.abs("skew") > limit)


def statistical_summary(df: DataFrame, names: list[str], most_tested: int = 20, most_paired: int = 10, least: int = 8, strong: float = 0.7) -> DataFrame:
    """(kind, a, b, value): ``normality`` p-values of the first ``most_tested`` columns with ``least`` values, and
    ``correlation`` of pairs of the first ``most_paired`` columns beyond ``strong``."""
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    out = [normality(df, c).select(F.lit("normality").alias("kind"), F.lit(c).alias("a"), F.lit(None).cast("string").alias("b"), F.col("pvalue").alias("value")) for c in names[:most_tested] if counts[c] >= least]
    out.append(correlated_pairs(df, names[:most_paired], strong).filter(F.abs("r") > strong).select(F.lit("correlation").alias("kind"), "a", "b", F.col("r").alias("value")))
    return reduce(DataFrame.unionByName, out)


def performance_change(current: DataFrame, baseline: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of both tables by key with their differences, current less baseline: <metric>, <metric>_baseline,
    <metric>_delta (rounded to 4). Keys of one table alone have null differences."""
    old = baseline.select(*key, *[F.col(m).alias(f"{m}_baseline") for m in metrics])
    d = current.select(*key, *metrics).join(old, key, "full")
    return d.withColumns({f"{m}_delta": F.round(F.col(m) - F.col(f"{m}_baseline"), 4) for m in metrics})


def alerts(drift: DataFrame) -> DataFrame:
    """A JSON alert for each drifted column."""
    bad = drift.filter("verdict <> 'none'")
    return bad.select("column", F.to_json(F.struct("column", F.round("psi", 4).alias("psi"), "verdict")).alias("alert"))
