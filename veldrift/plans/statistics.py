"""Queries for profiling, aggregates, tests and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import profiling as prof
from .adapters import BASE, table
from .features import S, base, over
from .registry import Registry

R = Registry()


def lineitem(s, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def orders(s, d: str) -> DataFrame:
    return table(s, d, "orders")


def _quality_sql(t: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, num in columns.items():
        share = lambda cond: f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 4)"
        zeros = f"{share(f'{c} = 0')} AS zeros_pct, {share(f'{c} < 0')} AS negatives_pct" if num else "NULL::DOUBLE AS zeros_pct, NULL::DOUBLE AS negatives_pct"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS "rows", CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS nulls, {share(f'{c} IS NULL')} AS null_pct, count(DISTINCT {c}) AS "unique",
          round(count(DISTINCT {c}) / count(*), 4) AS cardinality_pct, count(DISTINCT {c}) <= 1 AS constant, {zeros} FROM {t}""")
    return "(" + " UNION ALL ".join(parts) + ")"


ORDERS = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False}
R.table("quality_report", lambda s, d: prof.quality(orders(s, d).select(*ORDERS)), "", _quality_sql("orders", ORDERS), dict.fromkeys(["column", "rows", "nulls", "null_pct", "unique", "cardinality_pct", "constant", "zeros_pct", "negatives_pct"]))
R.table(
    "duplicate_rows", lambda s, d: prof.duplicates(lineitem(s, d).select("l_orderkey", "l_linenumber")), "",
    "(SELECT count(*) AS \"rows\", count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated_rows FROM lineitem)",
    dict.fromkeys(["rows", "distinct_rows", "repeated_rows"]),
)


def shaped(s, d: str) -> DataFrame:
    """Orders with a constant, a nearly empty and a leaking column."""
    o = orders(s, d)
    return o.select("o_totalprice", "o_orderpriority", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(1).alias("one"), F.when(F.col("o_orderkey") % 10 == 0, 1.0).alias("rare"), (F.col("o_totalprice") * 2 + 1).alias("leak"))


SHAPED = "shaped AS (SELECT o_totalprice, o_orderpriority, 'k' || o_orderkey AS id, 1 AS one, CASE WHEN o_orderkey % 10 = 0 THEN 1.0::DOUBLE END AS rare, o_totalprice * 2 + 1 AS leak FROM orders)"


def _out(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'outliers' AS kind, CAST(sum(CAST({c} < lo OR {c} > hi AS INTEGER)) AS DOUBLE) AS value FROM shaped, (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi, q[2] - q[1] AS iqr FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM shaped)) WHERE iqr > 0"""


R.table(
    "eda_findings", lambda s, d: prof.findings(shaped(s, d), "o_totalprice"), SHAPED,
    f"""(SELECT 'one' AS "column", 'constant' AS kind, CAST(count(DISTINCT one) AS DOUBLE) AS value FROM shaped UNION ALL SELECT 'rare', 'constant', CAST(count(DISTINCT rare) AS DOUBLE) FROM shaped
      UNION ALL SELECT 'id', 'high_cardinality', count(DISTINCT id) / count(*) FROM shaped UNION ALL SELECT 'rare', 'high_missing', avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0 END) FROM shaped
      UNION ALL SELECT * FROM ({_out('o_totalprice')}) WHERE value > 0 UNION ALL SELECT * FROM ({_out('leak')}) WHERE value > 0
      UNION ALL SELECT 'leak', 'leakage_suspect', corr(leak, o_totalprice) FROM shaped)""",
    {"column": None, "kind": None, "value": 6},
)
R.table(
    "imputation", lambda s, d: prof.imputation(shaped(s, d)), SHAPED,
    """(SELECT 'rare' AS "column", avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0 END) AS null_ratio, 'drop or flag' AS suggestion FROM shaped)""", {"column": None, "null_ratio": 6, "suggestion": None},
)

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
for method, factor in (("iqr", 0.5), ("zscore", 1.5)):
    bound = "q[1] - 0.5 * (q[2] - q[1]) AS lo, q[2] + 0.5 * (q[2] - q[1]) AS hi FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem)" if method == "iqr" else "avg({c}) - 1.5 * stddev_pop({c}) AS lo, avg({c}) + 1.5 * stddev_pop({c}) AS hi FROM lineitem"
    R.table(
        f"outliers_{method}", lambda s, d, m=method, f=factor: prof.outliers(lineitem(s, d).select(*NUMBERS), m, f), "",
        "(" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", min(lo) AS lower, min(hi) AS upper, CAST(sum(CAST({c} < lo OR {c} > hi AS INTEGER)) AS BIGINT) AS n_outliers, round(avg(CASE WHEN {c} < lo OR {c} > hi THEN 1.0 ELSE 0 END), 4) AS fraction FROM lineitem, (SELECT {bound.format(c=c)})""" for c in NUMBERS) + ")",
        {"column": None, "lower": 4, "upper": 4, "n_outliers": None, "fraction": None},
    )
R.table(
    "outlier_rows", lambda s, d: prof.outlier_rows(base(s, d).filter("return is not null"), "return", ["ticker", "timestamp"], 3.0), BASE,
    """(SELECT ticker, "timestamp", ("return" - m) / s AS z FROM base, (SELECT avg("return") AS m, stddev_pop("return") AS s FROM base) WHERE "return" IS NOT NULL AND abs(("return" - m) / s) > 3)""",
    {"ticker": None, "timestamp": None, "z": 6},
)
R.table(
    "describe", lambda s, d: prof.describe(lineitem(s, d), NUMBERS), "",
    "(" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS "min", quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3, max({c}) AS "max", skewness({c}) AS skew, kurtosis({c}) AS kurtosis FROM lineitem""" for c in NUMBERS) + ")",
    {"column": None, "n": None, "mean": 4, "sd": 4, "min": 4, "q1": 3, "median": 3, "q3": 3, "max": 4, "skew": 5, "kurtosis": 5},
)
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
R.table(
    "correlation_matrix", lambda s, d: prof.correlations(lineitem(s, d), PAIRS), "",
    "(" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + ")", {"a": None, "b": None, "r": 6},
)
R.table(
    "correlated_pairs", lambda s, d: prof.correlated_pairs(base(s, d), ["open", "close", "high", "vwap", "volume"], 0.5), BASE,
    "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM base" for i, a in enumerate(["open", "close", "high", "vwap", "volume"]) for b in ["open", "close", "high", "vwap", "volume"][i + 1 :]) + ") WHERE abs(r) >= 0.5)",
    {"a": None, "b": None, "r": 6},
)
R.table(
    "histogram", lambda s, d: prof.histogram(lineitem(s, d), "l_extendedprice"), "",
    "(SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1)", {"bin": None, "n": None},
)
R.table("top_values", lambda s, d: prof.top_values(table(s, d, "part"), "p_type", 5), "", "(SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5)", {"p_type": None, "n": None})

# Aggregates over bars
R.table(
    "market_aggregate", lambda s, d: base(s, d).groupBy("timestamp").agg(F.avg("return").alias("m")).filter("m is not null").withColumn("sd", F.stddev_samp("m").over(W.orderBy("timestamp").rowsBetween(-9, 0))),
    BASE + """, m AS (SELECT "timestamp", avg("return") AS m FROM base GROUP BY 1 HAVING avg("return") IS NOT NULL)""",
    """(SELECT *, stddev_samp(m) OVER (ORDER BY "timestamp" ROWS 9 PRECEDING) AS sd FROM m)""", {"timestamp": None, "m": 6, "sd": 6},
)
R.table(
    "autocorrelation", lambda s, d: base(s, d).withColumns({f"_l{k}": w.lag("return", k) for k in (1, 5, 10, 20)}).groupBy("ticker").agg(*[F.corr("return", f"_l{k}").alias(f"lag_{k}") for k in (1, 5, 10, 20)]),
    BASE + ", a AS (SELECT *, " + ", ".join(f'lag("return", {k}) OVER s AS l{k}' for k in (1, 5, 10, 20)) + f" FROM base {over()})",
    "(SELECT ticker, " + ", ".join(f'corr("return", l{k}) AS lag_{k}' for k in (1, 5, 10, 20)) + " FROM a GROUP BY 1)", {"ticker": None} | {f"lag_{k}": 6 for k in (1, 5, 10, 20)},
)
R.table(
    "annualised", lambda s, d: base(s, d).groupBy("ticker").agg((F.avg("return") * 252).alias("ret"), (F.stddev_samp("return") * F.sqrt(F.lit(252.0))).alias("vol"), (F.avg("return") / F.stddev_samp("return") * F.sqrt(F.lit(252.0))).alias("sharpe")),
    BASE, """(SELECT ticker, avg("return") * 252 AS ret, stddev_samp("return") * sqrt(252.0) AS vol, avg("return") / stddev_samp("return") * sqrt(252.0) AS sharpe FROM base GROUP BY 1)""", {"ticker": None, "ret": 4, "vol": 4, "sharpe": 6},
)
R.table(
    "validation_report", lambda s, d: base(s, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("ma_200").isNull().cast("long")).alias("nulls_ma_200"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.avg("return").alias("mean_return")),
    BASE, """(SELECT ticker, count(*) AS "rows", CAST(sum(CAST(ma_200 IS NULL AS INTEGER)) AS BIGINT) AS nulls_ma_200, min("timestamp") AS "first", max("timestamp") AS "last", avg("return") AS mean_return FROM base GROUP BY 1)""",
    {"ticker": None, "rows": None, "nulls_ma_200": None, "first": None, "last": None, "mean_return": 4},
)

# Tests. p-values in SQL are integrals of the density over the tail, by midpoints.
MIDPOINTS = 20_000


def _tail(density: str, start: str) -> str:
    """The integral of ``density`` (of @) from ``start`` to infinity."""
    at = f"({start} + (i + 0.5) / ({MIDPOINTS} - i - 0.5))"
    return f"(SELECT sum(({density.replace('@', at)}) * {MIDPOINTS}::DOUBLE / (({MIDPOINTS} - i - 0.5) * ({MIDPOINTS} - i - 0.5))) FROM range({MIDPOINTS}) g(i))"


def t_sql(t: str, dof: str) -> str:
    return "2 * " + _tail(f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0) - ln(pi() * {dof}) / 2 - ({dof} + 1) / 2.0 * ln(1 + @ * @ / {dof}))", f"abs({t})")


def chi2_sql(x: str, dof: str) -> str:
    return _tail(f"exp(({dof} / 2.0 - 1) * ln(@) - @ / 2 - {dof} / 2.0 * ln(2) - lgamma({dof} / 2.0))", x)


def f_sql(x: str, a: str, b: str) -> str:
    return _tail(f"exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0) + {a} / 2.0 * ln({a} / {b}::DOUBLE) + ({a} / 2.0 - 1) * ln(@) - ({a} + {b}) / 2.0 * ln(1 + {a} * @ / {b}))", x)


def normal_sql(z: str) -> str:
    return "2 * " + _tail("exp(-@ * @ / 2) / sqrt(2 * pi())", f"abs({z})")


def r_sql(r: str, n: str) -> str:
    return t_sql(f"({r} * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2)")


def with_p(p: str, source: str) -> str:
    return f"(SELECT *, {p} AS pvalue FROM {source} q)"


R.table(
    "t_test", lambda s, d: prof.t_test(base(s, d), "ticker", "log_volume", "A", "N").unionByName(prof.t_test(base(s, d), "ticker", "log_volume", "A", "N", False)),
    BASE + """, g AS (SELECT count(log_volume) FILTER (ticker = 'A') AS n1, count(log_volume) FILTER (ticker = 'N') AS n2, avg(log_volume) FILTER (ticker = 'A') AS m1, avg(log_volume) FILTER (ticker = 'N') AS m2,
      var_samp(log_volume) FILTER (ticker = 'A') AS v1, var_samp(log_volume) FILTER (ticker = 'N') AS v2 FROM base), p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pool FROM g)""",
    with_p(t_sql('statistic', 'dof'), """(SELECT (m1 - m2) / sqrt(pool * (1 / n1 + 1 / n2)) AS statistic, CAST(n1 + n2 - 2 AS DOUBLE) AS dof, (m1 - m2) / sqrt(pool) AS cohens_d FROM p
      UNION ALL SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2), pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), (m1 - m2) / sqrt(pool) FROM p)"""),
    {"statistic": 5, "dof": 3, "cohens_d": 6, "pvalue": 6},
)
R.table("paired_t", lambda s, d: prof.paired_t(base(s, d), "open", "close"), BASE, with_p(t_sql('statistic', 'dof'), "(SELECT avg(open - close) / (stddev_samp(open - close) / sqrt(count(*))) AS statistic, count(*) - 1 AS dof FROM base)"), {"statistic": 6, "dof": None, "pvalue": 6})
R.table(
    "anova", lambda s, d: prof.anova(base(s, d), "ticker", "log_volume"), BASE + ", g AS (SELECT ticker, count(*) AS n, avg(log_volume) AS m, var_samp(log_volume) AS v FROM base GROUP BY 1)",
    with_p(f_sql('statistic', 'dof_between', 'dof_within'), """(SELECT ((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS statistic, count(*) - 1 AS dof_between, CAST(sum(n) - count(*) AS BIGINT) AS dof_within FROM g)"""),
    {"statistic": 4, "dof_between": None, "dof_within": None, "pvalue": 6},
)
RANKS = ", r AS (SELECT ticker, volume, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS rk FROM base WHERE {c}), ties AS (SELECT sum(pow(c, 3) - c)::DOUBLE AS t, sum(c)::DOUBLE AS n FROM (SELECT count(*) AS c FROM base WHERE {c} GROUP BY volume))"
R.table(
    "kruskal", lambda s, d: prof.rank_tests(base(s, d), "ticker", "volume"), BASE + RANKS.format(c="TRUE") + ", g AS (SELECT ticker, sum(rk)::DOUBLE AS s, count(*) AS n FROM r GROUP BY 1)",
    with_p(chi2_sql('statistic', 'dof'), "(SELECT (12 / (min(ties.n) * (min(ties.n) + 1)) * sum(s * s / g.n) - 3 * (min(ties.n) + 1)) / (1 - min(t) / (pow(min(ties.n), 3) - min(ties.n))) AS statistic, count(*) - 1 AS dof FROM g, ties)"), {"statistic": 4, "dof": None, "pvalue": 6},
)
R.table(
    "mann_whitney", lambda s, d: prof.mann_whitney(base(s, d), "ticker", "volume", "A", "N"), BASE + RANKS.format(c="ticker IN ('A', 'N')"),
    with_p(f"least(1.0, {normal_sql('z')})", """(SELECT u AS statistic, greatest(0, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties.t / ((n1 + n2) * (n1 + n2 - 1))))) AS z FROM
      (SELECT sum(rk) FILTER (ticker = 'A') - n1 * (n1 + 1) / 2 AS u, n1, n2 FROM r, (SELECT count(*) FILTER (ticker = 'A')::DOUBLE AS n1, count(*) FILTER (ticker = 'N')::DOUBLE AS n2 FROM r) GROUP BY n1, n2), ties)"""),
    {"statistic": 3, "pvalue": 6},
)
R.table(
    "chi2_independence", lambda s, d: prof.chi2_independence(orders(s, d), "o_orderstatus", "o_orderpriority"),
    "t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS c FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(c)::DOUBLE AS ra FROM t GROUP BY 1), k AS (SELECT b, sum(c)::DOUBLE AS cb FROM t GROUP BY 1), n AS (SELECT sum(c)::DOUBLE AS n FROM t)",
    with_p(chi2_sql('statistic', 'dof'), "(SELECT sum(pow(coalesce(c, 0) - ra * cb / n, 2) / (ra * cb / n)) AS statistic, (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS dof FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN t ON t.a = r.a AND t.b = k.b)"), {"statistic": 5, "dof": None, "pvalue": 6},
)
R.table("chi2_fit", lambda s, d: prof.chi2_fit(orders(s, d), "o_orderpriority"), "c AS (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority)", with_p(chi2_sql('statistic', 'dof'), "(SELECT sum(c * c)::DOUBLE * count(*) / sum(c) - sum(c) AS statistic, count(*) - 1 AS dof FROM c)"), {"statistic": 6, "dof": None, "pvalue": 6})
R.table(
    "spearman", lambda s, d: prof.spearman(base(s, d), "volume", "close"),
    BASE, with_p(r_sql('statistic', 'n'), "(SELECT corr(a, b) AS statistic, count(*) AS n FROM (SELECT rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS a, rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2.0 AS b FROM base))"), {"statistic": 6, "n": None, "pvalue": 6},
)
for query, of, x, y in (("kendall", "lineitem", "l_discount", "l_tax"), ("kendall_continuous", "orders", "o_totalprice", "o_custkey")):
    R.table(
        query, lambda s, d, of=of, x=x, y=y: prof.kendall(table(s, d, of), x, y),
        f"c AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y, count(*) AS n FROM {of} GROUP BY 1, 2), " + ", ".join(f"t{k} AS (SELECT sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS u, sum(m * (m - 1) * (2 * m + 5)) AS v, sum(m) AS n FROM (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY {k}))" for k in "xy"),
        with_p(normal_sql("z"), """(SELECT s / sqrt((p / 2 - tx.t) * (p / 2 - ty.t)) AS statistic, CAST(ty.n AS BIGINT) AS n, s / sqrt((p * (2 * ty.n + 5) - tx.v - ty.v) / 18 + 2 * tx.t * ty.t / p + tx.u * ty.u / (9 * p * (ty.n - 2))) AS z FROM
          (SELECT sum(sign(b.x - a.x) * sign(b.y - a.y) * a.n * b.n)::DOUBLE AS s FROM c a JOIN c b ON a.x < b.x), tx, ty, (SELECT n * (n - 1) AS p FROM ty))"""),
        {"statistic": 8, "n": None, "pvalue": 6},
    )
R.table(
    "pearson", lambda s, d: prof.pearson(base(s, d), "volume", "return"), BASE,
    with_p(r_sql("statistic", "n"), """(SELECT corr(volume, "return") AS statistic, count(*) AS n FROM base WHERE volume IS NOT NULL AND "return" IS NOT NULL)"""), {"statistic": 6, "n": None, "pvalue": 6},
)
R.table(
    "yates", lambda s, d: prof.chi2_independence(orders(s, d).select((F.col("o_totalprice") > 150000).alias("large"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")), "large", "urgent"),
    "t AS (SELECT o_totalprice > 150000 AS a, o_orderpriority = '1-URGENT' AS b FROM orders), m AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a)::DOUBLE AS a, count(*) FILTER (b)::DOUBLE AS b, count(*) FILTER (a AND b)::DOUBLE AS ab FROM t), g AS (SELECT *, abs(ab - a * b / n) AS g FROM m)",
    with_p(chi2_sql("statistic", "dof"), "(SELECT pow(g - least(0.5, g), 2) * (n / (a * b) + n / (a * (n - b)) + n / ((n - a) * b) + n / ((n - a) * (n - b))) AS statistic, 1 AS dof FROM g)"), {"statistic": 6, "dof": None, "pvalue": 6},
)
SHARES = {"1-URGENT": 0.3, "2-HIGH": 0.2, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.2, "5-LOW": 0.1}
R.table(
    "chi2_expected", lambda s, d: prof.chi2_expected(orders(s, d), "o_orderpriority", SHARES),
    "e(x, share) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SHARES.items()) + "), c AS (SELECT share, count(o_orderkey)::DOUBLE AS o FROM e LEFT JOIN orders ON o_orderpriority = x GROUP BY x, share)",
    with_p(chi2_sql("statistic", "dof"), "(SELECT sum(pow(o - n * share, 2) / (n * share)) AS statistic, count(*) - 1 AS dof FROM c, (SELECT sum(o) AS n FROM c))"), {"statistic": 6, "dof": None, "pvalue": 6},
)


def _normality_sql(x: str, source: str) -> str:
    """D'Agostino and Pearson's statistic from central moments."""
    return f"""(SELECT z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS pvalue, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS normal FROM (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1,
      (1 - 2 / (9 * a) - sign((1 - 2 / a) / (1 + sd * sqrt(2 / (a - 4)))) * pow(abs((1 - 2 / a) / (1 + sd * sqrt(2 / (a - 4)))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM
      (SELECT *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a, sqrt(2 * (beta - 1)) - 1 AS w2 FROM
      (SELECT *, b1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
        (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS sd,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM
      (SELECT count({x})::DOUBLE AS n, avg(pow({x} - m, 3)) / pow(avg(pow({x} - m, 2)), 1.5) AS b1, avg(pow({x} - m, 4)) / pow(avg(pow({x} - m, 2)), 2) AS b2 FROM {source}, (SELECT avg({x}) AS m FROM {source}))))))"""


R.table("normality", lambda s, d: prof.normality(base(s, d), "log_volume"), BASE, _normality_sql("log_volume", "base"), {"statistic": 4, "pvalue": 8, "normal": None})
R.table(
    "skewed_columns", lambda s, d: prof.skewed(base(s, d).select("open", "volume", "return"), ["open", "volume", "return"], 0.0), BASE,
    "(" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", skewness("{c}") AS skew FROM base""" for c in ("open", "volume", "return")) + ")", {"column": None, "skew": 5},
)
R.table(
    "statistical_summary", lambda s, d: prof.statistical_summary(base(s, d), ["log_volume", "open", "close"]), BASE,
    "(" + " UNION ALL ".join(f"SELECT 'normality' AS kind, '{c}' AS a, NULL AS b, pvalue AS value FROM {_normality_sql(c, 'base')}" for c in ("log_volume", "open", "close"))
    + " UNION ALL SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'correlation' AS kind, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS value FROM base" for a, b in (("log_volume", "open"), ("log_volume", "close"), ("open", "close"))) + ") WHERE abs(value) > 0.7)",
    {"kind": None, "a": None, "b": None, "value": 6},
)

# Drift: the first 80 % of each series against its last 60 rows
COLS = ["return", "volatility", "rsi", "log_volume"]


def placed(s, d: str) -> DataFrame:
    by = W.partitionBy("ticker")
    return base(s, d).withColumns({"_n": F.row_number().over(by.orderBy("timestamp")), "_all": F.count(F.lit(1)).over(by)})


REF, CUR = "_n <= floor(_all * 0.8)", "_n > _all - 60"
PLACED = BASE + f", placed AS (SELECT *, row_number() OVER ({S}) AS _n, count(*) OVER (PARTITION BY ticker) AS _all FROM base)"


def _psi_sql(c: str) -> str:
    e = f"(SELECT list_sort(list_distinct(quantile_cont(\"{c}\", [{', '.join(str(k / 10) for k in range(11))}]))) AS e FROM placed WHERE {REF})"
    return f"""SELECT '{c}' AS "column", sum((q - p) * ln(q / p)) AS psi FROM (SELECT nr / sum(nr) OVER () + 1e-6 AS p, nc / sum(nc) OVER () + 1e-6 AS q FROM
      (SELECT len(list_filter(e[2:len(e) - 1], lambda v: v < "{c}")) AS bin, sum(CAST({REF} AS INTEGER)) AS nr, sum(CAST({CUR} AS INTEGER)) AS nc FROM placed, {e} WHERE "{c}" IS NOT NULL AND ({REF} OR {CUR}) GROUP BY 1))"""


PSI = PLACED + ", psi AS (" + " UNION ALL ".join(_psi_sql(c) for c in COLS) + ")"
R.table(
    "psi_drift", lambda s, d: prof.psi(placed(s, d), COLS, F.expr(REF), F.expr(CUR)), PSI,
    "(SELECT *, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS verdict FROM psi)", {"column": None, "psi": 6, "verdict": None},
)
R.table(
    "mean_shift_drift", lambda s, d: prof.mean_shift(placed(s, d), COLS, F.expr(REF), F.expr(CUR)), PLACED,
    "(SELECT m AS mean_shift, exp(-m) AS pvalue, exp(-m) < 0.05 AS drift FROM (SELECT (" + " + ".join(f'pow(avg("{c}") FILTER ({REF}) - avg("{c}") FILTER ({CUR}), 2) / (var_pop("{c}") FILTER ({REF}) + 1e-12 + var_pop("{c}") FILTER ({CUR}) + 1e-12)' for c in COLS) + ") / 4 AS m FROM placed))",
    {"mean_shift": 6, "pvalue": 6, "drift": None},
)
R.table(
    "ks_drift", lambda s, d: prof.ks(placed(s, d).filter(f"({REF}) or ({CUR})"), "return", F.expr(REF), F.expr(CUR)).select("statistic"), PLACED,
    f"""(SELECT max(abs(r - c)) AS statistic FROM (SELECT sum(CAST({REF} AS INTEGER)) OVER o / sum(CAST({REF} AS INTEGER)) OVER () AS r, sum(CAST({CUR} AS INTEGER)) OVER o / sum(CAST({CUR} AS INTEGER)) OVER () AS c
      FROM placed WHERE "return" IS NOT NULL WINDOW o AS (ORDER BY "return" RANGE UNBOUNDED PRECEDING)))""",
    {"statistic": 6},
)
R.table(
    "frequency_shift", lambda s, d: prof.frequency_shift(orders(s, d), "o_orderpriority", F.col("o_orderdate") < "1996-06-01", F.col("o_orderdate") >= "1996-06-01"), "",
    "(SELECT o_orderpriority, count(*) FILTER (o_orderdate < '1996-06-01') AS n_reference, count(*) FILTER (o_orderdate >= '1996-06-01') AS n_current FROM orders GROUP BY 1)", {"o_orderpriority": None, "n_reference": None, "n_current": None},
)
R.table(
    "drift_alerts", lambda s, d: prof.alerts(prof.psi(placed(s, d), COLS, F.expr(REF), F.expr(CUR))), PSI,
    """(SELECT "column", '{"column":' || to_json("column") || ',"psi":' || CAST(round(psi, 4) AS VARCHAR) || ',"verdict":"' || CASE WHEN psi >= 0.25 THEN 'significant' ELSE 'moderate' END || '"}' AS alert FROM psi WHERE psi >= 0.1)""",
    {"column": None, "alert": None},
)
OLD, NEW = "o_orderdate < '1996-06-01'", "o_orderdate >= '1996-06-01'"
R.table(
    "column_drift", lambda s, d: prof.column_drift(orders(s, d).withColumn("none", F.lit(None).cast("double")), ["o_totalprice", "none"], ["o_orderpriority"], F.expr(OLD), F.expr(NEW)).select("column", "test", "statistic", "drift"),
    """o AS (SELECT *, o_orderdate < '1996-06-01' AS r FROM orders), c AS (SELECT o_orderpriority AS x, r, count(*)::DOUBLE AS o FROM o GROUP BY 1, 2),
    e AS (SELECT o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY r) / sum(o) OVER () AS e FROM c), chi AS (SELECT sum(pow(o - e, 2) / e) AS statistic, 4 AS dof FROM e),
    k AS (SELECT max(abs(a - b)) AS statistic, min(n) AS n, min(m) AS m FROM (SELECT sum(r::INT) OVER w / n AS a, sum((NOT r)::INT) OVER w / m AS b, n, m FROM o, (SELECT sum(r::INT)::DOUBLE AS n, sum((NOT r)::INT)::DOUBLE AS m FROM o) WINDOW w AS (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING)))""",
    f"""(SELECT 'o_orderpriority' AS "column", 'chi2' AS test, statistic, {chi2_sql('statistic', 'dof')} < 0.05 AS drift FROM chi
      UNION ALL SELECT 'o_totalprice', 'ks', statistic, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * statistic > 1.3581 FROM k)""",
    {"column": None, "test": None, "statistic": 6, "drift": None},
)
R.table(
    "performance_change",
    lambda s, d: prof.performance_change(*[base(s, d).filter(c).groupBy("ticker").agg(F.avg("return").alias("mean"), F.stddev_samp("return").alias("sd")) for c in ("volume > 0 and minute(timestamp) % 2 = 0", "volume > 0 and minute(timestamp) % 3 = 0")], ["ticker"], ["mean", "sd"]),
    BASE + ", " + ", ".join(f"""{n} AS (SELECT ticker, avg("return") AS mean, stddev_samp("return") AS sd FROM base WHERE volume > 0 AND minute("timestamp") % {k} = 0 GROUP BY 1)""" for n, k in (("now", 2), ("old", 3))),
    "(SELECT coalesce(now.ticker, old.ticker) AS ticker, now.mean, old.mean AS mean_baseline, round(now.mean - old.mean, 4) AS mean_delta, now.sd, old.sd AS sd_baseline, round(now.sd - old.sd, 4) AS sd_delta FROM now FULL JOIN old ON now.ticker = old.ticker)",
    {"ticker": None, "mean": 6, "mean_baseline": 6, "mean_delta": 3, "sd": 6, "sd_baseline": 6, "sd_delta": 3},
)
