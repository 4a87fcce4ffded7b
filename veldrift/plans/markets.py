"""Queries over probabilities, bets and back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import sentiment, staking, trading
from .adapters import BETS, LEXICON, PROBS, SCORED, bets, news, probabilities
from .features import S, base, over, spec
from .registry import Registry

R = Registry()
GRID = [round(0.51 + 0.01 * k, 2) for k in range(20)]
REPORT = "final_equity:3 total_return cagr:4 sharpe max_drawdown win_rate buy_hold_return n_trades:-"


def probs(s, d: str) -> DataFrame:
    return probabilities(base(s, d))


def signalled(s, d: str, threshold: float = 0.6) -> DataFrame:
    trading.check_threshold(threshold)
    return probs(s, d).withColumn("signal", trading.signal(F.col("p"), F.lit(threshold)))


R.table("probabilities", probs, PROBS, "probs", {"ticker": None, "timestamp": None, "p": 6, "y": None})

SIGNALS = PROBS + """, signals AS (SELECT *, CASE WHEN p >= 0.6 THEN 'BUY' WHEN p <= 1 - 0.6::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS signal FROM probs)"""
R.table("signals", signalled, SIGNALS, "signals", {"ticker": None, "timestamp": None, "signal": None})


def equity_sql(source: str, key: str, cost: float, slippage: float) -> str:
    """Equity as a recursion-free product in SQL."""
    k = f'PARTITION BY {key} ORDER BY "timestamp"'
    c = f"({cost}::DOUBLE + {slippage}::DOUBLE)"
    return f"""k0 AS (SELECT *, coalesce(last_value(CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 0 END IGNORE NULLS) OVER (ROWS_), 0) AS position FROM {source}),
k1 AS (SELECT *, coalesce(lag(position) OVER s, 0) AS before, lag(close) OVER s AS prev FROM k0 WINDOW s AS ({k})),
k2 AS (SELECT *, position = 1 AND before = 0 AS entered, position = 0 AND before = 1 AS "left" FROM k1),
curve AS (SELECT *, 10000 * exp(sum(CASE WHEN before = 1 THEN ln(close / prev) ELSE 0 END - CASE WHEN entered THEN ln(1 + {c}) ELSE 0 END + CASE WHEN "left" THEN ln(1 - {c}) ELSE 0 END)
  OVER ({k} ROWS UNBOUNDED PRECEDING)) AS equity FROM k2)""".replace("ROWS_", f"{k} ROWS UNBOUNDED PRECEDING")


def report_sql(key: str) -> str:
    k = f'PARTITION BY {key} ORDER BY "timestamp"'
    return f"""k3 AS (SELECT *, equity / nullif(lag(equity) OVER s, 0) - 1 AS r, equity / max(equity) OVER (s ROWS UNBOUNDED PRECEDING) - 1 AS dd, signal <> 'HOLD' AND prev IS NOT NULL AS acts FROM curve WINDOW s AS ({k})),
k4 AS (SELECT {key}, count(*) AS n, arg_max(equity, "timestamp") AS final_equity, min(dd) AS max_drawdown, avg(r) AS mean, stddev_samp(r) AS sd, CAST(sum(CAST(entered AS INTEGER)) AS BIGINT) AS n_trades,
  sum(CAST(acts AS INTEGER)) AS acted, sum(CAST(acts AND close > prev AS INTEGER)) AS won, arg_max(close, "timestamp") / arg_min(close, "timestamp") - 1 AS buy_hold_return FROM k3 GROUP BY {key}),
report AS (SELECT {key}, n, final_equity, final_equity / 10000 - 1 AS total_return, CASE WHEN n > 1 THEN pow(final_equity / 10000, 252.0 / (n - 1)) - 1 ELSE 0 END AS cagr,
  CASE WHEN n > 2 AND sd > 0 THEN mean / sd * sqrt(252.0) ELSE 0 END AS sharpe, max_drawdown, coalesce(won / nullif(acted, 0), 0) AS win_rate, buy_hold_return, n_trades FROM k4)"""


for cost, slip, name in ((0.0, 0.0, "backtest"), (0.001, 0.0005, "backtest_with_costs")):
    R.table(
        name, lambda s, d, c=cost, x=slip: trading.backtest(signalled(s, d), ["ticker"], c, x),
        SIGNALS + ", " + equity_sql("signals", "ticker", cost, slip) + ", " + report_sql("ticker"), "report", {"ticker": None, "n": None} | spec(REPORT),
    )
R.table(
    "equity_curve", lambda s, d: trading.equity_curve(signalled(s, d), ["ticker"], 0.001, 0.0005),
    SIGNALS + ", " + equity_sql("signals", "ticker", 0.001, 0.0005), "curve", {"ticker": None, "timestamp": None} | spec("position:- entered:- left:- equity:2"),
)
R.table(
    "portfolio_report", lambda s, d: trading.with_portfolio(trading.backtest(signalled(s, d), ["ticker"])),
    SIGNALS + ", " + equity_sql("signals", "ticker", 0, 0) + ", " + report_sql("ticker") + """, combined AS (SELECT * FROM report UNION ALL
      SELECT 'portfolio', CAST(sum(n) AS BIGINT), avg(final_equity), avg(total_return), avg(cagr), avg(sharpe), avg(max_drawdown), avg(win_rate), avg(buy_hold_return), CAST(sum(n_trades) AS BIGINT) FROM report)""",
    "combined", {"ticker": None, "n": None} | spec(REPORT),
)
SWEEP = (
    PROBS
    + f", grid AS (SELECT unnest({GRID})::DOUBLE AS threshold), signals AS (SELECT *, CASE WHEN p >= threshold THEN 'BUY' WHEN p <= 1 - threshold THEN 'SELL' ELSE 'HOLD' END AS signal FROM probs, grid), "
    + equity_sql("signals", "ticker, threshold", 0, 0) + ", " + report_sql("ticker, threshold")
)
R.table("threshold_sweep", lambda s, d: trading.sweep(probs(s, d), GRID), SWEEP, "report", {"ticker": None, "threshold": None, "n": None} | spec(REPORT))
R.table(
    "best_threshold", lambda s, d: trading.best_threshold(trading.sweep(probs(s, d), GRID)), SWEEP,
    "(SELECT ticker, arg_max(threshold, (round(sharpe, 9), threshold)) AS threshold, arg_max(sharpe, (round(sharpe, 9), threshold)) AS sharpe FROM report GROUP BY 1)",
    {"ticker": None, "threshold": None, "sharpe": 6},
)
R.table(
    "paper_trades", lambda s, d: trading.trade_log(signalled(s, d), ["ticker"]), SIGNALS + ", " + equity_sql("signals", "ticker", 0, 0),
    """(SELECT ticker, "timestamp", CASE WHEN entered THEN 'BUY' ELSE 'SELL' END AS action, close AS price, equity / close AS shares, equity FROM curve WHERE entered OR "left")""",
    {"ticker": None, "timestamp": None, "action": None, "price": None, "shares": 6, "equity": 2},
)


def hybrid(s, d: str) -> DataFrame:
    daily = sentiment.daily(sentiment.score(news(s, d), LEXICON))
    return probabilities_with(sentiment.add_features(base(s, d), daily))


def probabilities_with(features: DataFrame) -> DataFrame:
    p = probabilities(features)
    d = p.join(features.select("ticker", "timestamp", "sentiment_score"), ["ticker", "timestamp"])
    return d.withColumn("signal", trading.hybrid_signal(F.col("p"), F.col("sentiment_score"), F.lit(0.6)))


def _hybrid_sql() -> str:
    from .adapters import BASE, NEWS

    sent = BASE + ", " + NEWS + ", " + SCORED + ", " + sentiment.DAILY_SQL + ", " + sentiment.features_sql(over)
    rest = PROBS[len(BASE) :]
    return sent + rest + """, signals AS (SELECT probs.*, sentiment_score, CASE WHEN p >= 0.6 AND sentiment_score > 0 THEN 'BUY' WHEN p <= 1 - 0.6::DOUBLE AND sentiment_score < 0 THEN 'SELL' ELSE 'HOLD' END AS signal
      FROM probs JOIN features USING (ticker, "timestamp"))"""


R.table("hybrid_signals", hybrid, _hybrid_sql(), "signals", {"ticker": None, "timestamp": None, "signal": None, "sentiment_score": 6})
R.table(
    "hybrid_backtest", lambda s, d: trading.backtest(hybrid(s, d), ["ticker"]), _hybrid_sql() + ", " + equity_sql("signals", "ticker", 0, 0) + ", " + report_sql("ticker"),
    "report", {"ticker": None, "n": None} | spec(REPORT),
)


def out_of_sample(s, d: str) -> DataFrame:
    """Threshold from the validation part (70 to 80 % of each series), back-test on the last 20 %."""
    n = F.row_number().over(W.partitionBy("ticker").orderBy("timestamp"))
    p = probs(s, d).withColumn("_at", n / F.count(F.lit(1)).over(W.partitionBy("ticker")))
    best = trading.best_threshold(trading.sweep(p.filter("_at > 0.7 and _at <= 0.8"), GRID)).select("ticker", "threshold")
    test = p.filter("_at > 0.8").join(best, "ticker").withColumn("signal", trading.signal(F.col("p"), F.col("threshold")))
    return trading.backtest(test, ["ticker", "threshold"], 0.001, 0.0005)


OOS = (
    PROBS
    + f""", placed AS (SELECT *, row_number() OVER ({S}) / count(*) OVER (PARTITION BY ticker) AS place FROM probs), grid AS (SELECT unnest({GRID})::DOUBLE AS threshold),
 signals AS (SELECT *, CASE WHEN p >= threshold THEN 'BUY' WHEN p <= 1 - threshold THEN 'SELL' ELSE 'HOLD' END AS signal FROM placed, grid WHERE place > 0.7 AND place <= 0.8), """
    + equity_sql("signals", "ticker, threshold", 0, 0) + ", " + report_sql("ticker, threshold")
    + ", best AS (SELECT ticker, arg_max(threshold, (round(sharpe, 9), threshold)) AS threshold FROM report GROUP BY 1), test AS (SELECT placed.*, threshold, CASE WHEN p >= threshold THEN 'BUY' WHEN p <= 1 - threshold THEN 'SELL' ELSE 'HOLD' END AS signal FROM placed JOIN best USING (ticker) WHERE place > 0.8), "
    + (equity_sql("test", "ticker, threshold", 0.001, 0.0005) + ", " + report_sql("ticker, threshold")).replace("k0", "j0").replace("k1", "j1").replace("k2", "j2").replace("k3", "j3").replace("k4", "j4").replace("curve", "jcurve").replace("report", "jreport")
)
R.table("out_of_sample_backtest", out_of_sample, OOS, "jreport", {"ticker": None, "threshold": None, "n": None} | spec(REPORT))

R.table(
    "realistic_backtest", lambda s, d: trading.realistic(base(s, d), "ticker"),
    PROBS + f""", n0 AS (SELECT ticker, "timestamp", "return" AS r, "return" - 15.0 / 10000 AS net FROM base WHERE "return" IS NOT NULL), n1 AS (SELECT *, sum(net) OVER ({S} ROWS UNBOUNDED PRECEDING) AS cum FROM n0),
    n2 AS (SELECT *, greatest(max(cum) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM n1)""",
    """(SELECT ticker, CAST(sum(CAST(abs(r) > 1e-18 AS INTEGER)) AS BIGINT) AS n_trades, sum(r) AS gross_return, sum(net) AS net_return, max(dd) AS max_drawdown, avg(net) / stddev_samp(net) AS sharpe,
      avg(net) / stddev_samp(CASE WHEN net < 0 THEN net END) AS sortino, max(dd) > 0.5 AS drawdown_triggered FROM n2 GROUP BY 1)""",
    {"ticker": None} | spec("n_trades:- gross_return:4 net_return:4 max_drawdown sharpe sortino drawdown_triggered:-"),
)


def allocation(s, d: str) -> DataFrame:
    last = base(s, d).filter("volatility is not null").groupBy("ticker").agg((1 / F.max_by("volatility", "timestamp")).alias("weight"), F.max_by("close", "timestamp").alias("price"))
    return trading.rebalance(last.withColumn("held", F.lit(1.0)), 10_000.0)


R.table(
    "allocation", allocation, PROBS + """, l AS (SELECT ticker, 1 / arg_max(volatility, "timestamp") AS weight, arg_max(close, "timestamp") AS price FROM base WHERE volatility IS NOT NULL GROUP BY 1)""",
    "(SELECT *, weight / sum(weight) OVER () AS share, weight / sum(weight) OVER () * 10000 AS budget, weight / sum(weight) OVER () * 10000 / price AS shares, weight / sum(weight) OVER () * 10000 / price - 1 AS delta FROM l)",
    {"ticker": None} | spec("share budget:3 shares delta"),
)
R.table(
    "drawdown", lambda s, d: ind.add_drawdown(base(s, d)).groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown")),
    PROBS, f'(SELECT ticker, min(dd) AS max_drawdown FROM (SELECT ticker, close / max(close) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM base) GROUP BY 1)', {"ticker": None, "max_drawdown": 6},
)

KELLY = (
    BETS
    + """, y0 AS (SELECT *, CASE WHEN odds_market > 1 THEN (p_model * (odds_market - 1) - (1 - p_model)) / (odds_market - 1) ELSE 0 END AS f FROM bets),
y1 AS (SELECT *, CASE WHEN bet_signal AND f > 0 THEN greatest(0.005, least(0.03, f * 0.1 * CASE confidence WHEN 'ALTA' THEN 1.0 WHEN 'BAJA' THEN 0.5 ELSE 0.85 END)) ELSE 0 END AS k FROM y0),
kelly AS (SELECT *, k * CASE WHEN sum(k) OVER () > 0.15 THEN 0.15 / sum(k) OVER () ELSE 1 END AS kelly_pct FROM y1)"""
)
R.table(
    "kelly_stakes", lambda s, d: staking.stakes(bets(s, d), 1000.0), KELLY, "(SELECT *, kelly_pct * 1000 AS kelly_stake, kelly_pct * 1000 * ev AS ev_per_unit FROM kelly)",
    {"bet_id": None, "kelly_pct": 10, "kelly_stake": 7, "ev_per_unit": 7},
)
RET = BETS + ", rets AS (SELECT *, CAST(won AS INTEGER) * odds_market - 1 AS ret FROM bets)"


def rets(s, d: str) -> DataFrame:
    return staking.bet_returns(bets(s, d))


def _ln(x: Column) -> Column:
    """The logarithm as SQL has it: minus infinity of 0, which Spark makes null."""
    return F.when(x == 0, float("-inf")).otherwise(F.log(x))


R.table("bet_returns", rets, RET, "rets", {"bet_id": None, "ret": 6})
FRACTIONS = [0.005, 0.01, 0.05, 0.15]
R.table(
    "kelly_growth", lambda s, d: staking.growth(rets(s, d), FRACTIONS), RET + f", fr AS (SELECT unnest({FRACTIONS})::DOUBLE AS fraction)",
    "(SELECT fraction, CASE WHEN min(1 + fraction * ret) <= 0 THEN -1e20 ELSE avg(ln(1 + fraction * ret)) END AS growth FROM rets, fr GROUP BY 1)", {"fraction": None, "growth": 9},
)
R.table(
    "bankroll", lambda s, d: staking.trajectory(rets(s, d).select("bet_id", "league", "ret"), 0.01, "bet_id", "league").withColumns({"log_bankroll": _ln(F.col("bankroll")), "log_drawdown": _ln(F.col("bankroll") / F.col("peak"))}), RET + """, g AS (SELECT *, 1000 * exp(sum(ln(1 + 0.01 * ret)) OVER (PARTITION BY league ORDER BY bet_id ROWS UNBOUNDED PRECEDING)) AS bankroll FROM rets)""",
    "(SELECT *, ln(bankroll) AS log_bankroll, ln(bankroll / greatest(1000, max(bankroll) OVER (PARTITION BY league ORDER BY bet_id ROWS UNBOUNDED PRECEDING))) AS log_drawdown FROM g)", {"bet_id": None, "log_bankroll": 6, "log_drawdown": 6},
)
R.table(
    "growth_and_drawdown", lambda s, d: staking.growth_and_drawdown(rets(s, d), FRACTIONS, "bet_id", "league"),
    RET + f""", fr AS (SELECT unnest({FRACTIONS})::DOUBLE AS fraction), g AS (SELECT league, fraction, bet_id, ln(1 + fraction * ret) AS x, sum(ln(1 + fraction * ret)) OVER w AS cum FROM rets, fr WINDOW w AS (PARTITION BY league, fraction ORDER BY bet_id ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT *, 1 - exp(cum - greatest(0, max(cum) OVER (PARTITION BY league, fraction ORDER BY bet_id ROWS UNBOUNDED PRECEDING))) AS dd FROM g)""",
    "(SELECT league, fraction, avg(x) AS growth, max(dd) AS max_drawdown FROM h GROUP BY 1, 2)", {"league": None, "fraction": None, "growth": 9, "max_drawdown": 6},
)
R.table(
    "bet_correlation", lambda s, d: staking.bet_correlation(bets(s, d)), BETS,
    """(SELECT a.bet_id, b.bet_id AS other, abs(a.ev) / 1.5 * (abs(b.ev) / 1.5) * 0.1 AS cov FROM bets a JOIN bets b ON a.league = b.league AND a.date = b.date AND a.bet_id < b.bet_id WHERE a.bet_signal AND b.bet_signal)""",
    {"bet_id": None, "other": None, "cov": 8},
)
R.table(
    "return_covariance", lambda s, d: staking.moments(base(s, d)), PROBS,
    """(SELECT x.ticker AS a, y.ticker AS b, avg(x."return") AS mean_a, avg(y."return") AS mean_b, covar_samp(x."return", y."return") AS cov FROM base x JOIN base y ON x."timestamp" = y."timestamp"
      WHERE x."return" IS NOT NULL AND y."return" IS NOT NULL GROUP BY 1, 2)""",
    {"a": None, "b": None, "mean_a": 6, "mean_b": 6, "cov": 5},
)
R.rows_only("risk_constrained_kelly", lambda s, d: staking.risk_constrained(rets(s, d), "bet_id", "league"))
R.rows_only("cvar_drawdown", lambda s, d: staking.cvar_drawdown(rets(s, d), 0.02, resamples=50))


def usual_bet(s, d: str) -> tuple[float, float]:
    """Mean probability and odds of all signalled bets."""
    r = bets(s, d).filter("bet_signal").agg(F.avg("p_model").alias("p"), F.avg("odds_market").alias("odds")).first()
    return r.p or 0.0, r.odds or 0.0


R.rows_only("risk_of_ruin", lambda s, d: staking.ruin_report(staking.ruin(s, *usual_bet(s, d), 0.05)))
R.rows_only("safe_fraction", lambda s, d: staking.largest_safe_fraction(s, *usual_bet(s, d), n_sims=2000))
R.rows_only("signal_portfolio", lambda s, d: staking.signal_portfolio(bets(s, d), 10_000.0))


R.table(
    "position_size", lambda s, d: probs(s, d).select("ticker", "timestamp", trading.position_size(F.lit(10_000.0), F.lit(0.02), F.col("close"), F.col("close") * (1 - F.col("p") + 0.4)).alias("shares")), PROBS,
    """(SELECT ticker, "timestamp", CASE WHEN p > 0.4 THEN 200 / (close - close * (1 - p + 0.4)) ELSE 0 END AS shares FROM probs)""", {"ticker": None, "timestamp": None, "shares": 4},
)


def weights(s, d: str) -> DataFrame:
    """Weights of the highest Sharpe ratio, from the covariances (one row per pair of tickers)."""
    names, mean, cov = staking.moment_arrays(staking.moments(base(s, d)))
    return s.createDataFrame([(x, float(v)) for x, v in zip(names, staking.max_sharpe(mean, cov), strict=True)], "ticker string, weight double")


def efficient_frontier(s, d: str) -> DataFrame:
    """The frontier of all tickers, none over 0.6 of it: a row for each target and ticker."""
    names, mean, cov = staking.moment_arrays(staking.moments(base(s, d)))
    rows = [(int(i), float(r.target), float(r.volatility), float(r.sharpe), x, float(v)) for i, r in staking.frontier(mean, cov, cap=0.6).iterrows() for x, v in zip(names, r.weights, strict=True)]
    return s.createDataFrame(rows, "point int, target double, volatility double, sharpe double, ticker string, weight double")


R.rows_only("efficient_frontier", efficient_frontier)
R.rows_only("max_sharpe_weights", weights)
