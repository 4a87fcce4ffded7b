"""Queries over bars: indicators, labels, regimes, sentiment and macro joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.quantiles import percentiles
from ..operators import indicators as ind
from ..operators import sentiment
from .adapters import BARS, BASE, LEXICON, MACRO, NEWS, SCORED, bars, macro, news
from .registry import Registry

R = Registry()
KEY = {"ticker": None, "timestamp": None}


def spec(text: str) -> dict[str, int | None]:
    """"a b:3 c:-" to {a: 6, b: 3, c: None}: digits to round to, None for values that are not rounded."""
    out: dict[str, int | None] = {}
    for x in text.split():
        name, _, digits = x.partition(":")
        out[name] = None if digits == "-" else int(digits or 6)
    return out


def base(spark, sf_dir: str) -> DataFrame:
    return ind.add_base(bars(spark, sf_dir))


R.table("bars", bars, BARS, "bars", KEY | spec("open:- high:- low:- close:- volume:-"))

R.table(
    "base_indicators", base, BASE, "base",
    KEY | spec("close:- return momentum_10 momentum_21 momentum_63 lag_1 lag_5 lag_20 volatility volatility_21 rsi:5 hl_range oc_range ma_50:3 ma_200:3 log_volume vwap:7 vwap_ratio day_of_week:- quarter:-"),
)

R.table(
    "warm_up_dropped", lambda s, d: ind.drop_warm_up(base(s, d), "return", "volatility", "rsi", "ma_50", "ma_200", "lag_20"),
    BASE, "(SELECT * FROM base WHERE \"return\" IS NOT NULL AND volatility IS NOT NULL AND rsi IS NOT NULL AND ma_50 IS NOT NULL AND ma_200 IS NOT NULL AND lag_20 IS NOT NULL)",
    KEY | spec("close:- return volatility rsi:5"),
)

S = 'PARTITION BY ticker ORDER BY "timestamp"'


def over(*sizes: int) -> str:
    return "WINDOW s AS (" + S + ")" + "".join(f", w{n} AS ({S} ROWS {n - 1} PRECEDING)" for n in sizes) + f", cum AS ({S} ROWS UNBOUNDED PRECEDING)"


def sql_full(n: int, agg: str, x: str, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {m or n} THEN {agg}({x}) OVER w{n} END"


DERIVED = (
    BASE
    + f""", d1 AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
    coalesce(volume * sign(close - lag(close) OVER s), 0) AS flow,
    {sql_full(20, 'avg', 'close')} AS ma_20, {sql_full(20, 'stddev_samp', 'close')} AS sd
  FROM base {over(20)}
), d2 AS (
  SELECT *, ma_20 + 2 * sd AS bollinger_upper, ma_20 - 2 * sd AS bollinger_lower, {sql_full(14, 'avg', 'tr')} AS atr_14,
    sum(flow) OVER cum AS obv, volume / {sql_full(20, 'avg', 'volume')} AS volume_ratio_20, volume / {sql_full(60, 'avg', 'volume')} AS volume_ratio_60,
    rsi - lag(rsi) OVER s AS rsi_delta, {sql_full(5, 'avg', 'rsi')} AS rsi_ma5, close / ma_50 AS close_to_ma50_ratio, close / ma_200 AS close_to_ma200_ratio,
    CAST(sign(ma_50 - ma_200) AS DOUBLE) AS ma_cross_signal, {sql_full(20, 'max', 'high')} AS hi, {sql_full(20, 'min', 'low')} AS lo,
    {sql_full(5, 'max', 'high')} / {sql_full(5, 'min', 'low')} AS high_low_ratio_5d,
    {', '.join(f"{sql_full(n, 'stddev_samp', chr(34) + 'return' + chr(34))} * sqrt(252.0) AS realized_vol_{n}" for n in (5, 10, 21, 63))},
    volume / lag(volume) OVER s - 1 AS volume_change
  FROM d1 {over(5, 10, 14, 20, 21, 60, 63)}
), d3 AS (
  SELECT *, (bollinger_upper - bollinger_lower) / ma_20 AS bollinger_width,
    (close - bollinger_lower) / nullif(bollinger_upper - bollinger_lower, 0) AS bollinger_position, atr_14 / close AS atr_14_pct,
    {sql_full(20, 'avg', 'obv')} AS obv_ma20, CASE WHEN rsi > rsi_ma5 THEN 1 ELSE -1 END AS rsi_signal,
    (close - lo) / nullif(hi - lo, 0) AS price_position_in_range, realized_vol_5 / nullif(realized_vol_21, 0) AS vol_ratio_5_21,
    "return" / nullif(realized_vol_21, 0) AS return_vol_ratio
  FROM d2 {over(20)}
), derived AS (SELECT *, CAST(sign(obv - obv_ma20) AS DOUBLE) AS obv_signal FROM d3)"""
)
R.table(
    "derived_features", lambda s, d: ind.add_derived(base(s, d)), DERIVED, "derived",
    KEY | spec("ma_20:3 bollinger_upper:3 bollinger_lower:3 bollinger_width bollinger_position atr_14:3 atr_14_pct obv:2 obv_ma20:3 obv_signal:- volume_ratio_20 volume_ratio_60 volume_change rsi_delta:5 rsi_ma5:5 rsi_signal:- close_to_ma50_ratio close_to_ma200_ratio ma_cross_signal:- price_position_in_range realized_vol_5 realized_vol_10 realized_vol_21 realized_vol_63 vol_ratio_5_21 return_vol_ratio high_low_ratio_5d"),
)

R.table(
    "calendar_features", lambda s, d: ind.add_calendar(bars(s, d)), BARS,
    """(SELECT ticker, "timestamp", CAST(month("timestamp") AS INTEGER) AS month, CAST(week("timestamp") AS INTEGER) AS week_of_year,
      CAST(day("timestamp") = 1 AS INTEGER) AS is_month_start, CAST("timestamp" = last_day("timestamp") AS INTEGER) AS is_month_end,
      CAST(day("timestamp") = 1 AND month("timestamp") IN (1, 4, 7, 10) AS INTEGER) AS is_quarter_start,
      CAST("timestamp" = last_day("timestamp") AND month("timestamp") IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end,
      CAST(month("timestamp") BETWEEN 5 AND 9 AS INTEGER) AS sell_in_may, CAST(month("timestamp") IN (1, 4, 7, 10) AS INTEGER) AS is_earnings_season FROM bars)""",
    KEY | spec("month:- week_of_year:- is_month_start:- is_month_end:- is_quarter_start:- is_quarter_end:- sell_in_may:- is_earnings_season:-"),
)

R.table(
    "interaction_features", lambda s, d: ind.evaluate(ind.add_interactions(base(s, d)), ind.INTERACTIONS | {"skipped": "return * nothing"}), BASE,
    """(SELECT *, "return" * log_volume AS return_x_volume, rsi * volatility AS rsi_x_volatility, momentum_21 * volatility_21 AS momentum_x_volatility,
      "return" * volatility AS ret_vol, rsi * momentum_10 AS rsi_mom10, hl_range * log_volume AS hl_vol, oc_range * "return" AS oc_ret,
      volatility * log_volume AS vol_vol, momentum_10 * momentum_21 AS mom10_21 FROM base)""",
    KEY | spec("return_x_volume rsi_x_volatility:5 momentum_x_volatility ret_vol rsi_mom10:5 hl_vol oc_ret vol_vol mom10_21"),
)

TREND = (
    BASE
    + f""", t1 AS (
  SELECT *, CASE WHEN count(volatility) OVER w252 = 252 THEN median(volatility) OVER w252 END AS med, {sql_full(252, 'max', 'close')} AS peak_252d FROM base {over(252)}
), t2 AS (
  SELECT *, CASE WHEN close > ma_200 THEN 1 ELSE 0 END AS trend_regime, CASE WHEN volatility > med THEN 1 ELSE 0 END AS volatility_regime,
    (close - peak_252d) / peak_252d AS drawdown_current FROM t1
), t3 AS (SELECT *, {sql_full(252, 'min', 'drawdown_current')} AS max_drawdown_252d FROM t2 {over(252)}),
trend AS (SELECT *, drawdown_current / nullif(max_drawdown_252d, 0) AS recovery_ratio FROM t3)"""
)
R.table(
    "trend_features", lambda s, d: ind.add_trend(base(s, d)), TREND, "trend",
    KEY | spec("trend_regime:- volatility_regime:- peak_252d:3 drawdown_current max_drawdown_252d recovery_ratio"),
)

HAR = (
    BASE
    + f""", h1 AS (SELECT *, "return" * "return" AS sq FROM base), h2 AS (
  SELECT *, ln({sql_full(1, 'avg', 'sq')} + 1e-10) AS har_d, ln({sql_full(5, 'avg', 'sq')} + 1e-10) AS har_w, ln({sql_full(22, 'avg', 'sq')} + 1e-10) AS har_m,
    {sql_full(10, 'stddev_samp', '"return"')} AS persistence_10 FROM h1 {over(1, 5, 10, 22)}
), har AS (SELECT *, har_d - har_w AS har_dw, har_w - har_m AS har_wm FROM h2)"""
)
R.table("har_features", lambda s, d: ind.add_har(base(s, d)), HAR, "har", KEY | spec("har_d har_w har_m har_dw har_wm persistence_10"))

MICRO = (
    BASE
    + f""", m0 AS (SELECT *, coalesce("return", 0) AS r, close - lag(close) OVER s AS dc FROM base {over()}), m1 AS (
  SELECT *, abs(r) AS ar, r * r AS sq, abs(r) / CASE WHEN volume * close = 0 THEN 1e-9 ELSE volume * close / 1e6 END AS illiq,
    lag(dc) OVER s AS dc1, lag(r * r) OVER s AS sq1, avg(vwap) OVER w5 AS v5, avg(vwap) OVER w20 AS v20 FROM m0 {over(5, 20)}
), micro AS (
  SELECT *, (close - open) / (high - low + 1e-9) AS ofi_proxy,
    coalesce(2 * sqrt(greatest(0, -CASE WHEN count(dc * dc1) OVER w20 >= 5 THEN covar_samp(dc, dc1) OVER w20 END)) * CASE WHEN count(dc * dc1) OVER w20 >= 5 THEN 1 END, 0) AS rolls_spread,
    coalesce(CASE WHEN count(*) OVER w20 >= 5 THEN avg(illiq) OVER w20 END, 0) AS amihud_illiquidity,
    coalesce(CASE WHEN count(*) OVER w20 >= 5 THEN covar_samp(ar, volume) OVER w20 / (var_samp(volume) OVER w20 + 1e-9) END, 0) AS price_impact,
    (close - v5) / (v5 + 1e-9) AS vwap_dev_5d, (close - v20) / (v20 + 1e-9) AS vwap_dev_20d,
    coalesce(CASE WHEN count(*) OVER w20 >= 5 THEN corr(r, log_volume) OVER w20 END, 0) AS vol_price_corr,
    coalesce(CASE WHEN count(*) OVER w63 >= 10 THEN stddev_samp(r) OVER w20 / (stddev_samp(r) OVER w63 + 1e-9) END, 1) AS rvol_ratio_20d_63d,
    coalesce(CASE WHEN count(*) OVER w60 >= 5 THEN avg(sq) OVER w60 END, 0) AS sq_ret_mean, coalesce(CASE WHEN count(*) OVER w60 >= 5 THEN avg(ar) OVER w60 END, 0) AS abs_ret_mean,
    coalesce(CASE WHEN count(sq1) OVER w60 >= 5 THEN corr(sq, sq1) OVER w60 END, 0) AS vol_clustering
  FROM m1 {over(20, 60, 63)}
)"""
)
R.table(
    "microstructure", lambda s, d: ind.add_microstructure(base(s, d)), MICRO, "micro",
    KEY | spec("ofi_proxy rolls_spread:3 amihud_illiquidity price_impact vwap_dev_5d vwap_dev_20d vol_price_corr rvol_ratio_20d_63d sq_ret_mean abs_ret_mean vol_clustering"),
)


def _moment_sql() -> str:
    out = []
    for n in (20, 60):
        for name, agg, least in (("skew", "skewness", 3), ("kurt", "kurtosis", 4)):
            flat = "0" if name == "skew" else "-3"
            out.append(f"coalesce(CASE WHEN count(*) OVER w{n} >= {max(n // 2, 5, least)} THEN CASE WHEN min(r) OVER w{n} = max(r) OVER w{n} THEN {flat} ELSE {agg}(r) OVER w{n} END END, 0) AS {name}_ret_{n}d")
    for n in (5, 10, 20, 60):
        m = max(n // 2, 3)
        out += [
            f"avg(r) OVER w{n} AS ret_mean_{n}d", f"coalesce(stddev_samp(r) OVER w{n}, 0) AS ret_std_{n}d",
            f"coalesce(CASE WHEN count(*) OVER w{n} >= {m} THEN CASE WHEN min(r) OVER w{n} = max(r) OVER w{n} THEN 0 ELSE skewness(r) OVER w{n} END END, 0) AS ret_skew_{n}d",
            f"coalesce(CASE WHEN count(*) OVER w{n} >= {max(m, 4)} THEN CASE WHEN min(r) OVER w{n} = max(r) OVER w{n} THEN -3 ELSE kurtosis(r) OVER w{n} END END, 0) AS ret_kurt_{n}d",
            f"CASE WHEN count(*) OVER w{n} < 3 OR min(r) OVER w{n} = max(r) OVER w{n} THEN 0 ELSE regr_r2(r, n) OVER w{n} END AS ret_r2_{n}d",
            f"coalesce(avg(r) OVER w{n} / (stddev_samp(r) OVER w{n} + 1e-9), 0) AS ret_info_ratio_{n}d",
        ]
    return ", ".join(out)


MOMENTS = BASE + f', n0 AS (SELECT *, coalesce("return", 0) AS r, CAST(row_number() OVER s AS DOUBLE) AS n FROM base {over()}), moments AS (SELECT *, {_moment_sql()} FROM n0 {over(5, 10, 20, 60)})'
R.table(
    "rolling_moments", lambda s, d: ind.add_moments(base(s, d)), MOMENTS, "moments",
    KEY | spec(" ".join(f"skew_ret_{n}d:5 kurt_ret_{n}d:4" for n in (20, 60)) + " " + " ".join(f"ret_mean_{n}d ret_std_{n}d ret_skew_{n}d:5 ret_kurt_{n}d:4 ret_r2_{n}d:5 ret_info_ratio_{n}d" for n in (5, 10, 20, 60))),
)


def _entropy_sql(x: str, n: int) -> str:
    m = max(n // 2, 5)
    at = f"list({x}) OVER w{n}"
    bins = f"list_transform({at}, lambda v: least(CAST(floor((v - list_min({at})) / ((list_max({at}) - list_min({at})) / 10)) AS INTEGER), 9))"
    term = f"list_sum(list_transform(range(10), lambda k: CASE WHEN len(list_filter(bins_{x}{n}, lambda b: b = k)) > 0 THEN -(len(list_filter(bins_{x}{n}, lambda b: b = k)) / len(bins_{x}{n})) * log2(len(list_filter(bins_{x}{n}, lambda b: b = k)) / len(bins_{x}{n})) ELSE 0 END))"
    return f"CASE WHEN count(*) OVER w{n} < {m} OR min({x}) OVER w{n} = max({x}) OVER w{n} THEN NULL ELSE {bins} END AS bins_{x}{n}", f"CASE WHEN bins_{x}{n} IS NULL THEN 0 ELSE {term} END AS {'ret' if x == 'r' else 'vol'}_entropy_{n}d"


_E = [_entropy_sql(x, n) for x in ("r", "log_volume") for n in (20, 60)]
ENTROPY = BASE + f', e0 AS (SELECT * REPLACE (round(log_volume, 9) AS log_volume), coalesce("return", 0) AS r FROM base), e1 AS (SELECT *, {", ".join(a for a, _ in _E)} FROM e0 {over(20, 60)}), entropy AS (SELECT *, {", ".join(b for _, b in _E)} FROM e1)'
R.table("entropy_features", lambda s, d: ind.add_entropy(base(s, d).withColumn("log_volume", F.round("log_volume", 9))), ENTROPY, "entropy", KEY | spec("ret_entropy_20d ret_entropy_60d vol_entropy_20d vol_entropy_60d"))

R.rows_only("hurst_features", lambda s, d: ind.add_hurst(base(s, d)).select("ticker", "timestamp", F.round("hurst_20d", 6).alias("hurst_20d"), F.round("hurst_60d", 6).alias("hurst_60d")))

SIGNAL = (
    BASE
    + f""", g0 AS (SELECT *, close / lag(close, 5) OVER s - 1 AS m5 FROM base {over()}), g1 AS (
  SELECT *, abs(greatest(-3, least(3, coalesce(m5 / greatest(volatility_21, 1e-8), 0)))) * CASE WHEN m5 IS NULL OR volatility_21 IS NULL THEN 0 ELSE 1 END AS z, coalesce((rsi - 50) / 50, 0) AS rn FROM g0
), g2 AS (
  SELECT *, 1 - exp(-greatest(0, least(30, z * (1 + abs(rn)) * 0.8))) AS eb_prob_up, 1 - exp(-greatest(0, least(30, z / 0.02))) AS eb_prob_large_move,
    CASE WHEN volatility_21 IS NOT NULL THEN greatest(0.05, least(0.95, 0.5 + rn * 0.1 - volatility_21 * 0.05)) END AS eb_prob_combined FROM g1
), signal AS (SELECT *, 0.4 * eb_prob_up + 0.3 * eb_prob_large_move + 0.3 * eb_prob_combined AS eb_signal FROM g2)"""
)
R.table("signal_features", lambda s, d: ind.add_signal_features(base(s, d)), SIGNAL, "signal", KEY | spec("eb_prob_up eb_prob_large_move eb_prob_combined eb_signal"))

LABELS = (
    BASE
    + f""", l0 AS (SELECT *, lead(close, 5) OVER s / close - 1 AS future_return,
    CASE WHEN count("return") OVER f10 = 10 THEN stddev_samp("return") OVER f10 END AS future_vol_10, lead("return") OVER s AS next_return,
    {', '.join(f"CAST(lead(close, {h}) OVER s > close AS INTEGER) AS direction_{h}" for h in (1, 3, 5, 10, 20))}
  FROM base {over()}, f10 AS ({S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)
), labels AS (SELECT *, CAST(future_return > 0.02 AS INTEGER) AS target FROM l0)"""
)
R.table("forward_labels", lambda s, d: ind.add_labels(base(s, d)), LABELS, "labels", KEY | spec("future_return target:- future_vol_10 next_return direction_1:- direction_3:- direction_5:- direction_10:- direction_20:-"))


def scaled_labels(s, d: str) -> DataFrame:
    """Labels whose threshold is the 70th percentile of the forward returns of each horizon."""
    out = None
    b = bars(s, d)
    for h in (1, 5, 20):
        f = b.select("ticker", "timestamp", (F.try_divide(w.lead("close", h), F.col("close")) - 1).alias("f")).filter("f is not null")
        cut = F.lit(percentiles(f, [F.col("f")], [0.7])[0][0]).cast("double")
        part = f.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("f") > cut).cast("long")).alias("n_up")).withColumns({"cut": cut, "horizon": F.lit(h)})
        out = part if out is None else out.unionByName(part)
    return out


SCALED = BARS + ", scaled AS (" + " UNION ALL ".join(
    f"""SELECT ticker, count(*) AS n, CAST(sum(CAST(f > cut AS INTEGER)) AS BIGINT) AS n_up, min(cut) AS cut, {h} AS horizon FROM
      (SELECT *, (SELECT quantile_cont(f, 0.7) FROM (SELECT lead(close, {h}) OVER ({S}) / close - 1 AS f FROM bars) WHERE f IS NOT NULL) AS cut
       FROM (SELECT ticker, lead(close, {h}) OVER ({S}) / close - 1 AS f FROM bars) WHERE f IS NOT NULL) GROUP BY ticker"""
    for h in (1, 5, 20)
) + ")"
R.table("scaled_labels", scaled_labels, SCALED, "scaled", {"ticker": None, "horizon": None, "n": None, "n_up": None, "cut": 6})


def with_macro(s, d: str) -> DataFrame:
    """Macro columns of each bar by date, filled forward, and regimes."""
    m = macro(s, d)
    out = base(s, d).join(F.broadcast(m), F.col("timestamp") == F.col("date"), "left")
    for x in ("xlk", "xlf", "xle", "treasury_yield", "usd_index"):
        out = out.withColumn(f"_{x}", w.forward_fill(x))
    out = out.withColumn("vix_level", w.forward_fill("vix_close"))
    out = out.withColumns({
        "vix_ma20": w.minp(20, 1, F.avg, "vix_level"), "vix_change": F.coalesce(F.col("vix_level") - w.lag("vix_level"), F.lit(0.0)),
        "treasury_change": F.coalesce(F.col("_treasury_yield") - w.lag("_treasury_yield"), F.lit(0.0)),
        "usd_change": F.coalesce(F.col("_usd_index") - w.lag("_usd_index"), F.lit(0.0)),
    } | {f"sector_{x}": F.coalesce(w.change(f"_{x}"), F.lit(0.0)) for x in ("xlk", "xlf", "xle")})
    out = out.withColumns({"treasury_yield": F.col("_treasury_yield"), "usd_index": F.col("_usd_index")})
    return out.withColumn("regime", ind.regime(F.col("return"), F.col("volatility"), F.col("vix_level")))


FILLED = (
    BASE
    + ", "
    + MACRO
    + f""", f0 AS (SELECT base.*, vix_close, xlk, xlf, xle, treasury_yield AS ty, usd_index AS ui FROM base LEFT JOIN macro ON "timestamp" = date), f1 AS (
  SELECT *, {', '.join(f"coalesce(last_value({x} IGNORE NULLS) OVER cum, 0) AS f_{x}" for x in ('vix_close', 'xlk', 'xlf', 'xle', 'ty', 'ui'))} FROM f0 {over()}
), filled AS (
  SELECT *, f_vix_close AS vix_level, avg(f_vix_close) OVER w20 AS vix_ma20, coalesce(f_vix_close - lag(f_vix_close) OVER s, 0) AS vix_change,
    f_ty AS treasury_yield, coalesce(f_ty - lag(f_ty) OVER s, 0) AS treasury_change, f_ui AS usd_index, coalesce(f_ui - lag(f_ui) OVER s, 0) AS usd_change,
    {', '.join(f"coalesce(f_{x} / nullif(lag(f_{x}) OVER s, 0) - 1, 0) AS sector_{x}" for x in ('xlk', 'xlf', 'xle'))},
    CASE WHEN "return" >= 0.05 / 60 AND CASE WHEN volatility IS NULL OR volatility = 0 THEN 0.2 ELSE volatility END <= 0.2 AND f_vix_close <= 20 THEN 'bull'
         WHEN "return" < 0 AND CASE WHEN volatility IS NULL OR volatility = 0 THEN 0.2 ELSE volatility END >= 0.2 * 0.8 AND f_vix_close >= 30.0 * 0.7 THEN 'bear' ELSE 'neutral' END AS regime
  FROM f1 {over(20)}
)"""
)
R.table("macro_and_regime", with_macro, FILLED, "filled", KEY | spec("vix_level vix_ma20 vix_change treasury_yield treasury_change usd_index usd_change sector_xlk sector_xlf sector_xle regime:-"))
R.table(
    "regime_distribution", lambda s, d: with_macro(s, d).groupBy("ticker", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("return").alias("mean_return")),
    FILLED, '(SELECT ticker, regime, count(*) AS n, avg("return") AS mean_return FROM filled GROUP BY 1, 2)', {"ticker": None, "regime": None, "n": None, "mean_return": 6},
)


def volatility_terciles(s, d: str) -> DataFrame:
    b = base(s, d).filter("volatility is not null")
    n = F.row_number().over(w.series())
    b = b.withColumns({"_n": n, "_all": F.count(F.lit(1)).over(w.W.partitionBy("ticker"))})
    return ind.terciles(b, "volatility", F.col("_n") <= F.floor(F.col("_all") * 0.8))


TERCILES = (
    BASE
    + f""", v0 AS (SELECT *, row_number() OVER ({S}) AS n, count(*) OVER (PARTITION BY ticker) AS total FROM base WHERE volatility IS NOT NULL),
c AS (SELECT ticker, quantile_cont(volatility, 1.0::DOUBLE / 3) AS lo, quantile_cont(volatility, 2.0::DOUBLE / 3) AS hi FROM v0 WHERE n <= floor(total * 0.8) GROUP BY 1),
terciles AS (SELECT v0.ticker, "timestamp", CASE WHEN volatility <= lo THEN 'low' WHEN volatility <= hi THEN 'mid' ELSE 'high' END AS volatility_regime FROM v0 JOIN c USING (ticker))"""
)
R.table("volatility_terciles", volatility_terciles, TERCILES, "terciles", KEY | spec("volatility_regime:-"))


def daily(s, d: str) -> DataFrame:
    return sentiment.daily(sentiment.score(news(s, d), LEXICON))


R.table(
    "news_sentiment", lambda s, d: sentiment.score(news(s, d), LEXICON), NEWS + ", " + SCORED, "scored",
    {"doc_id": None, "ticker": None, "date": None, "n_positive": None, "n_negative": None, "delta": None, "compound": 6},
)
R.table(
    "news_polarity", lambda s, d: sentiment.polarity(news(s, d), LEXICON), NEWS + ", " + sentiment.polarity_sql(LEXICON), "polar",
    {"doc_id": None, "ticker": None, "date": None, "neg": 3, "neu": 3, "pos": 3, "compound": 6},
)
R.table(
    "daily_sentiment", daily, NEWS + ", " + SCORED + ", " + sentiment.DAILY_SQL, "daily",
    {"ticker": None, "date": None, "compound": 6, "n": None},
)


def with_sentiment(s, d: str) -> DataFrame:
    return sentiment.add_features(base(s, d), daily(s, d))


R.table(
    "sentiment_features", with_sentiment, BASE + ", " + NEWS + ", " + SCORED + ", " + sentiment.DAILY_SQL + ", " + sentiment.features_sql(over), "features",
    KEY | spec("sentiment_score sentiment_noticias:- sentiment_ma5 sentiment_ma20 sentiment_ma60 sentiment_vol sentiment_zscore:5 sentiment_trend sentiment_rsi:5 sentiment_vol_ratio:2 sentiment_crown news_volume:- news_volume_ma5 sentiment_extreme:- sentiment_change sentiment_change_ma5"),
)
R.table(
    "sentiment_coverage",
    lambda s, d: with_sentiment(s, d).groupBy("ticker").agg(*[F.sum((F.col(x) != 0).cast("long")).alias(f"n_{x}") for x in ("sentiment_score", "news_volume")], *[(100 * F.avg((F.col(x) != 0).cast("double"))).alias(f"pct_{x}") for x in ("sentiment_score", "news_volume")]),
    BASE + ", " + NEWS + ", " + SCORED + ", " + sentiment.DAILY_SQL + ", " + sentiment.features_sql(over),
    """(SELECT ticker, CAST(sum(CAST(sentiment_score <> 0 AS INTEGER)) AS BIGINT) AS n_sentiment_score, CAST(sum(CAST(news_volume <> 0 AS INTEGER)) AS BIGINT) AS n_news_volume,
      100 * avg(CAST(sentiment_score <> 0 AS INTEGER)) AS pct_sentiment_score, 100 * avg(CAST(news_volume <> 0 AS INTEGER)) AS pct_news_volume FROM features GROUP BY 1)""",
    {"ticker": None, "n_sentiment_score": None, "n_news_volume": None, "pct_sentiment_score": 6, "pct_news_volume": 6},
)
