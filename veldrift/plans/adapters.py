"""Canonical tables from the driver's tables, as DataFrames and as the same SQL for DuckDB.

bars: one series per return flag, a price being extended price by quantity. news: documents by source and day. macro:
daily events. probabilities: a closed form of RSI and return. bets: orders. graph: customers, nations, regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sentiment import MARKET, scored_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, timestamp, open, high, low, close, volume)."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("timestamp"), "l_quantity",
        price.alias("price"), order.alias("o"),
    )
    return li.groupBy("ticker", "timestamp").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"), F.sum("l_quantity").alias("volume"),
    )


BARS = """bars AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS "timestamp",
    arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
)"""

#: Base indicators in DuckDB's SQL, over ``bars``.
BASE = (
    BARS
    + """, b1 AS (
  SELECT *, close - lag(close) OVER s AS d, close / lag(close) OVER s - 1 AS "return",
    close / lag(close, 10) OVER s - 1 AS momentum_10, close / lag(close, 21) OVER s - 1 AS momentum_21,
    close / lag(close, 63) OVER s - 1 AS momentum_63, (high + low + close) / 3 AS vwap
  FROM bars WINDOW s AS (PARTITION BY ticker ORDER BY "timestamp")
), base AS (
  SELECT ticker, "timestamp", open, high, low, close, volume, "return", momentum_10, momentum_21, momentum_63, vwap,
    lag("return", 1) OVER s AS lag_1, lag("return", 5) OVER s AS lag_5, lag("return", 20) OVER s AS lag_20,
    CASE WHEN count("return") OVER w20 = 20 THEN stddev_samp("return") OVER w20 END AS volatility,
    CASE WHEN count("return") OVER w21 = 21 THEN stddev_samp("return") OVER w21 END AS volatility_21,
    CASE WHEN count(*) OVER w14 = 14 THEN 100 - 100 / (1 + avg(coalesce(greatest(d, 0), 0)) OVER w14 / (avg(coalesce(greatest(-d, 0), 0)) OVER w14 + 1e-9)) END AS rsi,
    (high - low) / close AS hl_range, (open - close) / close AS oc_range,
    CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS ma_50,
    CASE WHEN count(*) OVER w200 = 200 THEN avg(close) OVER w200 END AS ma_200,
    ln(1 + volume) AS log_volume, close / vwap AS vwap_ratio,
    CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week, CAST(quarter("timestamp") AS INTEGER) AS quarter
  FROM b1 WINDOW s AS (PARTITION BY ticker ORDER BY "timestamp"),
    w14 AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 19 PRECEDING),
    w21 AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 20 PRECEDING), w50 AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 49 PRECEDING),
    w200 AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 199 PRECEDING)
)"""
)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, title, body, source): a document's first line and the rest."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("doc_id") % 3 + 1).cast("int")).alias("ticker"),
        F.date_add(F.lit("1995-06-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("date"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), "source", "doc_id",
    )


NEWS = """news AS (
  SELECT ['A', 'N', 'R'][doc_id % 3 + 1] AS ticker, DATE '1995-06-01' + CAST(doc_id % 90 AS INTEGER) AS date,
    split_part(text, chr(10), 1) AS title, text AS body, source, doc_id
  FROM documents
)"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, vix_close, xlk, xlf, xle, treasury_yield, usd_index): a mean per day and event type, with gaps."""
    e = table(spark, sf_dir, "events")
    kinds = ("vix_close", "xlk", "xlf", "xle", "treasury_yield", "usd_index")
    date = F.date_add(F.lit("1995-01-02").cast("date"), (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 2).cast("int"))
    e = e.select(date.alias("date"), (F.col("event_id") % 7).alias("k"), "value")
    return e.groupBy("date").agg(*[F.avg(F.when(F.col("k") == i, F.col("value"))).alias(x) for i, x in enumerate(kinds)])


MACRO = """macro AS (
  SELECT DATE '1995-01-02' + CAST(2 * (CAST(ts AS DATE) - DATE '2024-01-01') AS INTEGER) AS date,
    avg(CASE WHEN event_id % 7 = 0 THEN value END) AS vix_close, avg(CASE WHEN event_id % 7 = 1 THEN value END) AS xlk,
    avg(CASE WHEN event_id % 7 = 2 THEN value END) AS xlf, avg(CASE WHEN event_id % 7 = 3 THEN value END) AS xle,
    avg(CASE WHEN event_id % 7 = 4 THEN value END) AS treasury_yield, avg(CASE WHEN event_id % 7 = 5 THEN value END) AS usd_index
  FROM events GROUP BY 1
)"""


def probabilities(base: DataFrame) -> DataFrame:
    """(ticker, timestamp, close, return, p, y): p a logistic of RSI, y whether the close rises over 5 rows."""
    from ..functions import windows as w

    p = 1 / (1 + F.exp(-(F.col("rsi") - 50) / 10))
    d = base.select("ticker", "timestamp", "close", "return", "volatility", p.alias("p"), w.lead("close", 5).alias("_c5"))
    d = d.withColumn("y", (F.col("_c5") > F.col("close")).cast("int")).drop("_c5")
    return d.filter("p is not null and y is not null")


PROBS = (
    BASE
    + """, p0 AS (
  SELECT ticker, "timestamp", close, "return", volatility, 1 / (1 + exp(-(rsi - 50) / 10)) AS p,
    CAST(lead(close, 5) OVER (PARTITION BY ticker ORDER BY "timestamp") > close AS INTEGER) AS y
  FROM base
), probs AS (SELECT * FROM p0 WHERE p IS NOT NULL AND y IS NOT NULL)"""
)


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bet_id, p_model, odds_market, ev, bet_signal, won, confidence, league, date)."""
    o = table(spark, sf_dir, "orders")
    p = (F.col("o_orderkey") * 37 % 1000) / 1000.0
    odds = 1.2 + (F.col("o_custkey") % 40) / 10.0
    return o.select(
        F.col("o_orderkey").alias("bet_id"), p.alias("p_model"), odds.alias("odds_market"), (p * odds - 1).alias("ev"),
        (p * odds > 1.05).alias("bet_signal"), (F.col("o_orderkey") * 7919 % 100 < 45).alias("won"),
        F.element_at(F.array(F.lit("ALTA"), F.lit("MEDIA"), F.lit("BAJA")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("confidence"),
        F.col("o_orderpriority").alias("league"), F.col("o_orderdate").cast("date").alias("date"),
    )


BETS = """bets AS (
  SELECT o_orderkey AS bet_id, (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS p_model, 1.2::DOUBLE + (o_custkey % 40) / 10.0::DOUBLE AS odds_market,
    (o_orderkey * 37 % 1000) / 1000.0::DOUBLE * (1.2::DOUBLE + (o_custkey % 40) / 10.0::DOUBLE) - 1 AS ev,
    (o_orderkey * 37 % 1000) / 1000.0::DOUBLE * (1.2::DOUBLE + (o_custkey % 40) / 10.0::DOUBLE) > 1.05::DOUBLE AS bet_signal,
    o_orderkey * 7919 % 100 < 45 AS won, ['ALTA', 'MEDIA', 'BAJA'][o_orderkey % 3 + 1] AS confidence,
    o_orderpriority AS league, CAST(o_orderdate AS DATE) AS date
  FROM orders
)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, community) and edges (source, target): customer, nation, region; supplier, nation."""
    c, n, r, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "supplier"))
    tag = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    nodes = (
        c.select(tag("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("community"))
        .unionByName(n.select(tag("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), tag("r", "n_regionkey").alias("community")))
        .unionByName(r.select(tag("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("region").alias("type"), F.lit(None).cast("string").alias("community")))
        .unionByName(s.select(tag("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("type"), F.lit(None).cast("string").alias("community")))
    )
    edges = (
        c.select(tag("c", "c_custkey").alias("source"), tag("n", "c_nationkey").alias("target"))
        .unionByName(n.select(tag("n", "n_nationkey").alias("source"), tag("r", "n_regionkey").alias("target")))
        .unionByName(s.select(tag("s", "s_suppkey").alias("source"), tag("n", "s_nationkey").alias("target")))
    )
    return nodes, edges


GRAPH = """nodes AS (
  SELECT 'c' || c_custkey AS id, c_name AS label, 'customer' AS type, c_mktsegment AS community FROM customer
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'region', NULL FROM region
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', NULL FROM supplier
), edges AS (
  SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
)"""


#: Words of the test corpora, so that their invented prose has scores too.
PROSE = {
    "the": 0.1, "and": 0.2, "that": -0.3, "with": 0.4, "was": -0.2, "der": 0.1, "die": -0.2, "und": 0.3, "la": 0.1,
    "le": -0.1, "que": 0.2, "de": -0.1, "idiot": -3.0, "worthless": -2.5, "thing": 0.5, "not": -0.5, "nicht": -0.5, "pas": -0.5,
}
LEXICON = MARKET | PROSE
SCORED = scored_sql(LEXICON)
