"""Queries for row, join and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import relational as rel
from .adapters import BASE, MACRO, macro, table
from .features import LABELS, S, base
from .registry import Registry

R = Registry()

R.table(
    "ml_ready", lambda s, d: rel.ml_ready(ind.add_labels(base(s, d))), LABELS,
    "(SELECT * FROM labels WHERE target IS NOT NULL AND ma_200 IS NOT NULL AND volatility IS NOT NULL AND rsi IS NOT NULL AND lag_20 IS NOT NULL)",
    {"ticker": None, "timestamp": None, "close": None, "return": 6, "volatility": 6, "rsi": 5, "ma_200": 3, "vwap_ratio": 6, "lag_20": 6, "target": None},
)
R.rows_only("sample_rows", lambda s, d: rel.sample(table(s, d, "orders"), 100, ["o_orderkey"]))
R.table(
    "forward_filled_macro", lambda s, d: rel.forward_fill(macro(s, d).withColumn("k", F.lit("m")), ["vix_close", "xlk"], "k", "date").select("date", "vix_close", "xlk"), MACRO,
    "(SELECT date, coalesce(last_value(vix_close IGNORE NULLS) OVER o, 0) AS vix_close, coalesce(last_value(xlk IGNORE NULLS) OVER o, 0) AS xlk FROM macro WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING))",
    {"date": None, "vix_close": 6, "xlk": 6},
)
R.table(
    "one_hot", lambda s, d: rel.one_hot(table(s, d, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(F.sum("o_orderstatus_O").alias("n_o"), F.sum("o_orderstatus_P").alias("n_p")), "",
    "(SELECT o_orderstatus, CAST(sum(CAST(o_orderstatus = 'O' AS INTEGER)) AS BIGINT) AS n_o, CAST(sum(CAST(o_orderstatus = 'P' AS INTEGER)) AS BIGINT) AS n_p FROM orders GROUP BY 1)", dict.fromkeys(["o_orderstatus", "n_o", "n_p"]),
)
R.table(
    "standardised", lambda s, d: rel.standardise(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], F.col("o_orderkey") % 5 != 0), "",
    "(SELECT o_orderkey, (o_totalprice - m) / s AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0))", {"o_orderkey": None, "o_totalprice": 6},
)
R.table(
    "equal_width_bins", lambda s, d: rel.binned(table(s, d, "part"), "p_retailprice", 7).groupBy("p_retailprice_bin").agg(F.count(F.lit(1)).alias("n")), "",
    "(SELECT least(CAST(floor((p_retailprice - lo) / ((hi - lo) / 7)) AS INTEGER), 6) AS p_retailprice_bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY 1)", {"p_retailprice_bin": None, "n": None},
)


def joined(s, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    p = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c, p


BOTH = "f AS (SELECT 0 AS frame, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 1, s_name, s_nationkey, s_acctbal FROM supplier)"
R.table(
    "union_keep_first", lambda s, d: rel.union_keep_first(list(joined(s, d)), ["nation"], [F.desc("balance"), F.asc("name")]), BOTH,
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY frame, balance DESC, name) AS n FROM f) WHERE n = 1)", dict.fromkeys(["name", "nation", "balance"]),
)
R.table("set_intersection", lambda s, d: joined(s, d)[0].select("nation").intersect(joined(s, d)[1].select("nation")), "", "(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)", {"nation": None})
R.table(
    "semi_join", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "", "(SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))", {"c_custkey": None},
)
R.table(
    "anti_join", lambda s, d: rel.not_in(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey").select("c_custkey"), "", "(SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))", {"c_custkey": None},
)
R.table(
    "left_join_by_two_keys", lambda s, d: table(s, d, "nation").join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("n")), "n_nationkey", "left").select("n_nationkey", F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("n", F.lit(0)).alias("n")), "",
    "(SELECT n_nationkey, coalesce(avg(c_acctbal), 0) AS balance, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)", {"n_nationkey": None, "balance": 4, "n": None},
)
R.table("last_rows", lambda s, d: rel.last_rows(base(s, d), 60).select("ticker", "timestamp", "close"), BASE, f'(SELECT * FROM (SELECT *, row_number() OVER ({S} DESC) AS n FROM base) WHERE n <= 60)', dict.fromkeys(["ticker", "timestamp", "close"]))
R.table(
    "capped_by_group", lambda s, d: rel.capped(table(s, d, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 2).select("p_brand", "p_partkey", "p_retailprice"), "",
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2)", dict.fromkeys(["p_brand", "p_partkey", "p_retailprice"]),
)
R.table("last_valid_row", lambda s, d: base(s, d).filter("ma_200 is not null").groupBy("ticker").agg(F.max("timestamp").alias("timestamp"), F.max_by("rsi", "timestamp").alias("rsi")), BASE, '(SELECT ticker, max("timestamp") AS "timestamp", arg_max(rsi, "timestamp") AS rsi FROM base WHERE ma_200 IS NOT NULL GROUP BY 1)', {"ticker": None, "timestamp": None, "rsi": 5})


def side_by_side(s, d: str) -> DataFrame:
    o = table(s, d, "orders")
    half = lambda c: o.filter(c).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    return rel.compare(half(F.col("o_orderkey") % 2 == 0), half(F.col("o_orderkey") % 2 == 1), "o_orderpriority", ["price"])


R.table(
    "report_comparison", side_by_side, "", "(SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) - avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS price_delta FROM orders GROUP BY 1)", {"o_orderpriority": None, "price_delta": 4},
)
R.rows_only("series_export", lambda s, d: rel.export(ind.add_har(base(s, d)).select("ticker", "timestamp", "har_d")))
