"""Signals, long/flat back-tests, paper trading, sweeps, allocation: without loops over rows.

The position after a day is the last signal that is not HOLD, so equity is a cumulative sum of log factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252.0


def check_threshold(threshold: float) -> None:
    if not 0.5 < threshold <= 1.0:
        raise ValueError(f"the threshold must be over 0.5 and at most 1, not {threshold}")


def signal(p: Column, threshold: Column) -> Column:
    return F.when(p >= threshold, "BUY").when(p <= 1 - threshold, "SELL").otherwise("HOLD")


def hybrid_signal(p: Column, sentiment: Column, threshold: Column, least: float = 0.0) -> Column:
    """A signal only where probability and sentiment agree."""
    if least < 0:
        raise ValueError("the sentiment threshold must not be negative")
    return F.when((p >= threshold) & (sentiment > least), "BUY").when((p <= 1 - threshold) & (sentiment < -least), "SELL").otherwise("HOLD")


def equity_curve(d: DataFrame, key: list[str], cost: float = 0.0, slippage: float = 0.0, capital: float = 10_000.0) -> DataFrame:
    """Adds position, entered, left and equity to rows of key, timestamp, close, signal.

    BUY enters when flat and SELL leaves when long, at the close and its costs; equity is marked to the close. Costs
    must sum to less than 1 and prices be positive.
    """
    if not 0 <= cost + slippage < 1:
        raise ValueError("costs must sum to less than 1")
    s = W.partitionBy(*key).orderBy("timestamp")
    cum = s.rowsBetween(W.unboundedPreceding, 0)
    state = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", 0)
    d = d.withColumn("position", F.coalesce(F.last(state, ignorenulls=True).over(cum), F.lit(0)))
    d = d.withColumns({"_before": F.coalesce(F.lag("position").over(s), F.lit(0)), "_prev": F.lag("close").over(s)})
    d = d.withColumns({"entered": (F.col("position") == 1) & (F.col("_before") == 0), "left": (F.col("position") == 0) & (F.col("_before") == 1)})
    # Bought at close * (1 + costs) and marked at close, so the entry's cost falls on the entry's day.
    factor = (
        F.when(F.col("_before") == 1, F.log(F.col("close") / F.col("_prev"))).otherwise(0.0)
        - F.when(F.col("entered"), F.log(F.lit(1 + cost + slippage))).otherwise(0.0)
        + F.when(F.col("left"), F.log(F.lit(1 - cost - slippage))).otherwise(0.0)
    )
    d = d.withColumn("_factor", factor)
    return d.withColumn("equity", capital * F.exp(F.sum("_factor").over(cum))).drop("_before", "_prev", "_factor")


def backtest(d: DataFrame, key: list[str], cost: float = 0.0, slippage: float = 0.0, capital: float = 10_000.0, risk_free: float = 0.0) -> DataFrame:
    """One row per key: the metrics of its long/flat strategy."""
    s = W.partitionBy(*key).orderBy("timestamp")
    cum = s.rowsBetween(W.unboundedPreceding, 0)
    e = equity_curve(d, key, cost, slippage, capital)
    e = e.withColumns({"_r": F.try_divide(F.col("equity"), F.lag("equity").over(s)) - 1, "_prev": F.lag("close").over(s), "_peak": F.max("equity").over(cum)})
    e = e.withColumns({"_dd": F.col("equity") / F.col("_peak") - 1, "_acts": (F.col("signal") != "HOLD") & F.col("_prev").isNotNull()})
    m = e.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "timestamp").alias("final_equity"), F.min("_dd").alias("max_drawdown"),
        F.avg(F.col("_r") - risk_free / YEAR).alias("_mean"), F.stddev_samp("_r").alias("_sd"),
        F.sum(F.col("entered").cast("long")).alias("n_trades"), F.sum(F.col("_acts").cast("long")).alias("_acted"),
        F.sum((F.col("_acts") & (F.col("close") > F.col("_prev"))).cast("long")).alias("_won"),
        (F.max_by("close", "timestamp") / F.min_by("close", "timestamp") - 1).alias("buy_hold_return"),
    )
    total = F.col("final_equity") / capital - 1
    return m.select(
        *key, "n", "final_equity", total.alias("total_return"),
        F.when(F.col("n") > 1, F.pow(1 + total, F.lit(YEAR) / (F.col("n") - 1)) - 1).otherwise(0.0).alias("cagr"),
        F.when((F.col("n") > 2) & (F.col("_sd") > 0), F.col("_mean") / F.col("_sd") * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("sharpe"),
        "max_drawdown", F.coalesce(F.try_divide(F.col("_won"), F.col("_acted")), F.lit(0.0)).alias("win_rate"), "buy_hold_return", "n_trades",
    )


def sweep(probs: DataFrame, thresholds: list[float], cost: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """The back-test of every key at every threshold: the rows are repeated once per threshold, in one pass."""
    for t in thresholds:
        check_threshold(t)
    d = probs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    d = d.withColumn("signal", signal(F.col("p"), F.col("threshold")))
    return backtest(d, ["ticker", "threshold"], cost, slippage)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the highest Sharpe ratio of each key; of equals the larger."""
    at = F.struct(F.round("sharpe", 9).alias("s"), "threshold")
    return swept.groupBy("ticker").agg(F.max_by("threshold", at).alias("threshold"), F.max_by("sharpe", at).alias("sharpe"))


def with_portfolio(report: DataFrame) -> DataFrame:
    """A report by ticker and the portfolio's row: means of ratios, sums of counts."""
    ratios = [c for c in report.columns if c not in ("ticker", "n", "n_trades")]
    total = report.agg(F.lit("portfolio").alias("ticker"), *[F.avg(c).alias(c) for c in ratios], F.sum("n").alias("n"), F.sum("n_trades").alias("n_trades"))
    return report.unionByName(total)


def trade_log(d: DataFrame, key: list[str], capital: float = 10_000.0) -> DataFrame:
    """The paper portfolio's trades: all in on entry, all out on exit, without costs; shares and cash."""
    e = equity_curve(d, key, capital=capital)
    trades = e.filter(F.col("entered") | F.col("left"))
    return trades.select(
        *key, "timestamp", F.when(F.col("entered"), "BUY").otherwise("SELL").alias("action"), F.col("close").alias("price"),
        (F.col("equity") / F.col("close")).alias("shares"), "equity",
    )


def allocate(weights: DataFrame, capital: float) -> DataFrame:
    """Weights that sum to 1 and the budget of each row of (ticker, weight, price)."""
    share = F.col("weight") / F.sum("weight").over(W.partitionBy(F.lit(1)))
    return weights.withColumn("share", share).withColumns({"budget": F.col("share") * capital, "shares": F.col("share") * capital / F.col("price")})


def rebalance(holdings: DataFrame, capital: float) -> DataFrame:
    """Target shares and the difference from the shares held, of rows (ticker, weight, price, held)."""
    a = allocate(holdings, capital)
    return a.withColumn("delta", F.col("shares") - F.col("held"))


def position_size(capital: Column, risk: Column, price: Column, stop: Column) -> Column:
    """Shares that lose ``risk`` of the capital if the price falls to the stop; 0 without room."""
    room = price - stop
    return F.when(room > 0, capital * risk / room).otherwise(0.0)


def realistic(returns: DataFrame, key: str, fees_bps: float = 10.0, slippage_bps: float = 5.0, risk_free: float = 0.0, limit: float = 0.5) -> DataFrame:
    """Additive equity of returns net of a cost per period: Sharpe, Sortino, drawdown and whether it passes a limit."""
    s = W.partitionBy(key).orderBy("timestamp")
    cum = s.rowsBetween(W.unboundedPreceding, 0)
    net = F.col("return") - (fees_bps + slippage_bps) / 10_000
    d = returns.filter("return is not null").withColumn("_net", net).withColumn("_cum", F.sum("_net").over(cum))
    d = d.withColumn("_dd", F.greatest(F.max("_cum").over(cum), F.lit(0.0)) - F.col("_cum"))
    neg = F.when(F.col("_net") < 0, F.col("_net"))
    m = d.groupBy(key).agg(
        F.sum((F.abs("return") > 1e-18).cast("long")).alias("n_trades"), F.sum("return").alias("gross_return"), F.sum("_net").alias("net_return"),
        F.greatest(F.max("_dd"), F.lit(0.0)).alias("max_drawdown"), F.avg("_net").alias("_mean"), F.stddev_samp("_net").alias("_sd"),
        F.count(neg).alias("_n"), F.stddev_samp(neg).alias("_down"), F.first(neg, ignorenulls=True).alias("_one"),
    )
    down = F.when(F.col("_n") > 1, F.col("_down")).when(F.col("_n") == 1, F.abs("_one")).when(F.col("_mean") < 0, F.abs("_mean")).otherwise(1e-18)
    return m.select(
        key, "n_trades", "gross_return", "net_return", "max_drawdown",
        F.when(F.col("_sd") > 1e-18, (F.col("_mean") - risk_free) / F.col("_sd")).otherwise(0.0).alias("sharpe"),
        ((F.col("_mean") - risk_free) / F.greatest(down, F.lit(1e-18))).alias("sortino"), (F.col("max_drawdown") > limit).alias("drawdown_triggered"),
    )
