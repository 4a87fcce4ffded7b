"""Technical indicators of keyed daily bars: (ticker, timestamp, open, high, low, close, volume).

Every function adds columns and keeps the rows. Helper columns start with an underscore and are dropped again.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import change, full, lag, minp, trailing


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def add_base(bars: DataFrame) -> DataFrame:
    """Returns, momentum, volatility, RSI-14, ranges, moving averages, volume, VWAP, calendar."""
    d = bars.withColumns({"_d": F.col("close") - lag("close"), "return": change("close")})
    d = d.withColumns({
        "_up": F.coalesce(F.greatest("_d", F.lit(0.0)), F.lit(0.0)),
        "_down": F.coalesce(F.greatest(-F.col("_d"), F.lit(0.0)), F.lit(0.0)),
    })
    vwap = F.col("vwap") if "vwap" in bars.columns else (F.col("high") + F.col("low") + F.col("close")) / 3
    d = d.withColumns({
        "momentum_10": change("close", 10), "momentum_21": change("close", 21), "momentum_63": change("close", 63),
        "lag_1": lag("return", 1), "lag_5": lag("return", 5), "lag_20": lag("return", 20),
        "volatility": full(20, F.stddev_samp, "return"), "volatility_21": full(21, F.stddev_samp, "return"),
        "rsi": 100 - 100 / (1 + full(14, F.avg, "_up") / (full(14, F.avg, "_down") + 1e-9)),
        "hl_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "oc_range": F.try_divide(F.col("open") - F.col("close"), F.col("close")),
        "ma_50": full(50, F.avg, "close"), "ma_200": full(200, F.avg, "close"),
        "log_volume": F.log1p("volume"), "vwap": vwap, "vwap_ratio": F.try_divide(F.col("close"), vwap),
        "day_of_week": F.weekday("timestamp"), "quarter": F.quarter("timestamp"),
    })
    return _tidy(d)


def add_derived(d: DataFrame) -> DataFrame:
    """Bollinger bands, ATR, OBV, volume ratios, RSI change, positions, realised volatility, calendar flags."""
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    prev = lag("close")
    d = d.withColumns({
        "_tr": F.greatest(h - low, F.abs(h - prev), F.abs(low - prev)),
        "_flow": F.coalesce(v * F.signum(c - prev), F.lit(0.0)),
        "ma_20": full(20, F.avg, "close"), "_sd": full(20, F.stddev_samp, "close"),
    })
    d = d.withColumns({
        "bollinger_upper": F.col("ma_20") + 2 * F.col("_sd"),
        "bollinger_lower": F.col("ma_20") - 2 * F.col("_sd"),
        "atr_14": full(14, F.avg, "_tr"),
        "obv": F.sum("_flow").over(w.cumulative()),
        "volume_ratio_20": F.try_divide(v, full(20, F.avg, "volume")),
        "volume_ratio_60": F.try_divide(v, full(60, F.avg, "volume")),
        "rsi_delta": F.col("rsi") - lag("rsi"),
        "rsi_ma5": full(5, F.avg, "rsi"),
        "close_to_ma50_ratio": F.try_divide(c, F.col("ma_50")), "close_to_ma200_ratio": F.try_divide(c, F.col("ma_200")),
        "ma_cross_signal": F.signum(F.col("ma_50") - F.col("ma_200")),
        "_hi": full(20, F.max, "high"), "_lo": full(20, F.min, "low"),
        "high_low_ratio_5d": F.try_divide(full(5, F.max, "high"), full(5, F.min, "low")),
    } | {f"realized_vol_{n}": full(n, F.stddev_samp, "return") * F.sqrt(F.lit(252.0)) for n in (5, 10, 21, 63)})
    d = d.withColumns({
        "bollinger_width": F.try_divide(F.col("bollinger_upper") - F.col("bollinger_lower"), F.col("ma_20")),
        "bollinger_position": F.try_divide(c - F.col("bollinger_lower"), F.col("bollinger_upper") - F.col("bollinger_lower")),
        "atr_14_pct": F.try_divide(F.col("atr_14"), c),
        "obv_ma20": full(20, F.avg, "obv"),
        "volume_change": F.try_divide(v, lag("volume")) - 1,
        "rsi_signal": F.when(F.col("rsi") > F.col("rsi_ma5"), 1).otherwise(-1),
        "price_position_in_range": F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo")),
        "vol_ratio_5_21": F.try_divide(F.col("realized_vol_5"), F.col("realized_vol_21")),
        "return_vol_ratio": F.try_divide(F.col("return"), F.col("realized_vol_21")),
    })
    d = d.withColumn("obv_signal", F.signum(F.col("obv") - F.col("obv_ma20")))
    return _tidy(d)


def add_calendar(d: DataFrame) -> DataFrame:
    """Month, ISO week, ends of month and quarter, and two season flags."""
    t = F.col("timestamp").cast("date")
    month = F.month(t)
    return d.withColumns({
        "month": month, "week_of_year": F.weekofyear(t),
        "is_month_start": (F.dayofmonth(t) == 1).cast("int"), "is_month_end": (t == F.last_day(t)).cast("int"),
        "is_quarter_start": ((F.dayofmonth(t) == 1) & (month % 3 == 1)).cast("int"),
        "is_quarter_end": ((t == F.last_day(t)) & (month % 3 == 0)).cast("int"),
        "sell_in_may": month.between(5, 9).cast("int"), "is_earnings_season": (month % 3 == 1).cast("int"),
    })


def add_interactions(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "return_x_volume": F.col("return") * F.col("log_volume"), "rsi_x_volatility": F.col("rsi") * F.col("volatility"),
        "momentum_x_volatility": F.col("momentum_21") * F.col("volatility_21"),
    })


def evaluate(d: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Columns from SQL expressions; an expression over a column that is not there is left out."""
    for name, text in expressions.items():
        used = [w for w in re.findall(r"[A-Za-z_]\w*", text)]
        if all(u in d.columns for u in used):
            d = d.withColumn(name, F.expr(re.sub(r"([A-Za-z_]\w*)", r"`\1`", text)))
    return d


def aliases(d: DataFrame) -> DataFrame:
    """The declared feature names that stand for derived ones."""
    names = {
        "bb_position": "bollinger_position", "bb_width": "bollinger_width", "atr_ratio": "atr_14_pct",
        "volume_ratio": "volume_ratio_20", "rsi_ma": "rsi_ma5", "rsi_change": "rsi_delta", "vol_ratio": "vol_ratio_5_21",
        "drawdown": "drawdown_current",
    }
    d = d.withColumns({a: F.col(b) for a, b in names.items() if b in d.columns})
    return d.withColumn("obv_change", change("obv")) if "obv" in d.columns else d


def add_trend(d: DataFrame) -> DataFrame:
    """Trend and volatility regime, 252-row peak, drawdown, worst drawdown, recovery."""
    d = d.withColumns({"_median": full(252, lambda x: F.percentile(x, 0.5), "volatility"), "peak_252d": full(252, F.max, "close")})
    d = d.withColumns({
        "trend_regime": F.when(F.col("close") > F.col("ma_200"), 1).otherwise(0),
        "volatility_regime": F.when(F.col("volatility") > F.col("_median"), 1).otherwise(0),
        "drawdown_current": F.try_divide(F.col("close") - F.col("peak_252d"), F.col("peak_252d")),
    })
    d = d.withColumn("max_drawdown_252d", full(252, F.min, "drawdown_current"))
    return _tidy(d.withColumn("recovery_ratio", F.try_divide(F.col("drawdown_current"), F.col("max_drawdown_252d"))))


def add_har(d: DataFrame) -> DataFrame:
    """Log realised variance over 1, 5 and 22 rows and their differences; trailing volatility as the baseline."""
    d = d.withColumn("_sq", F.col("return") * F.col("return"))
    d = d.withColumns({f"har_{name}": F.log(full(n, F.avg, "_sq") + 1e-10) for name, n in (("d", 1), ("w", 5), ("m", 22))})
    d = d.withColumns({"har_dw": F.col("har_d") - F.col("har_w"), "har_wm": F.col("har_w") - F.col("har_m"), "persistence_10": full(10, F.stddev_samp, "return")})
    return _tidy(d)


INTERACTIONS = {
    "ret_vol": "return * volatility", "rsi_mom10": "rsi * momentum_10", "hl_vol": "hl_range * log_volume",
    "oc_ret": "oc_range * return", "vol_vol": "volatility * log_volume", "mom10_21": "momentum_10 * momentum_21",
}


def _zero(x: Column, at: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(at))


def add_microstructure(d: DataFrame) -> DataFrame:
    """Interactions, spread, illiquidity, impact, VWAP deviation, order flow, volatility ratios and clustering.

    Of these the first return of a series counts as 0.
    """
    c, v = F.col("close"), F.col("volume")
    d = evaluate(d, INTERACTIONS).withColumn("_r", _zero(F.col("return")))
    d = d.withColumns({
        "_dc": c - lag("close"), "_abs": F.abs("_r"), "_sq": F.col("_r") * F.col("_r"),
        "_illiq": F.abs("_r") / F.when(v * c == 0, 1e-9).otherwise(v * c / 1e6),
        "ofi_proxy": (c - F.col("open")) / (F.col("high") - F.col("low") + 1e-9),
        "_v5": minp(5, 1, F.avg, "vwap"), "_v20": minp(20, 1, F.avg, "vwap"),
    })
    d = d.withColumns({"_dc1": lag("_dc"), "_sq1": lag("_sq")})
    d = d.withColumns({
        "rolls_spread": _zero(2 * F.sqrt(F.greatest(F.lit(0.0), -minp(20, 5, F.covar_samp, "_dc", "_dc1")))),
        "amihud_illiquidity": _zero(minp(20, 5, F.avg, "_illiq")),
        "price_impact": _zero(minp(20, 5, F.covar_samp, "_abs", "volume") / (minp(20, 5, F.var_samp, "volume") + 1e-9)),
        "vwap_dev_5d": (c - F.col("_v5")) / (F.col("_v5") + 1e-9), "vwap_dev_20d": (c - F.col("_v20")) / (F.col("_v20") + 1e-9),
        "vol_price_corr": _zero(w.corr("_r", "log_volume", 20, 5)),
        "rvol_ratio_20d_63d": _zero(minp(20, 5, F.stddev_samp, "_r") / (minp(63, 10, F.stddev_samp, "_r") + 1e-9), 1.0),
        "sq_ret_mean": _zero(minp(60, 5, F.avg, "_sq")), "abs_ret_mean": _zero(minp(60, 5, F.avg, "_abs")),
        "vol_clustering": _zero(w.corr("_sq", "_sq1", 60, 5)),
    })
    return _tidy(d)


def add_moments(d: DataFrame) -> DataFrame:
    """Skew and kurtosis of 20 and 60 rows; mean, sd, skew, kurtosis, R2 against time and information ratio of 5 to 60."""
    d = d.withColumns({"_n": F.row_number().over(w.series()).cast("double"), "_r": _zero(F.col("return"))})
    cols: dict[str, Column] = {}
    for n in (20, 60):
        at, m = trailing(n), max(n // 2, 5)
        cols |= {f"skew_ret_{n}d": _zero(w.skew("_r", at, m)), f"kurt_ret_{n}d": _zero(w.kurtosis("_r", at, m))}
    for n in (5, 10, 20, 60):
        at, m = trailing(n), max(n // 2, 3)
        cols |= {
            f"ret_mean_{n}d": F.avg("_r").over(at), f"ret_std_{n}d": _zero(F.stddev_samp("_r").over(at)),
            f"ret_skew_{n}d": _zero(w.skew("_r", at, m)), f"ret_kurt_{n}d": _zero(w.kurtosis("_r", at, m)),
            f"ret_r2_{n}d": _zero(F.pow(w.corr("_r", "_n", n, 3), F.lit(2.0))),
            f"ret_info_ratio_{n}d": _zero(F.avg("_r").over(at) / (F.stddev_samp("_r").over(at) + 1e-9)),
        }
    return _tidy(d.withColumns(cols))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def entropy(x: Column, bins: int = 10) -> Column:
    """Shannon entropy in bits of an array's equal-width histogram; 0 if all are equal."""
    edges = F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), F.size(x).alias("n"))
    binned = _let(edges, lambda e: F.transform(x, lambda v: F.least(F.floor((v - e["lo"]) / ((e["hi"] - e["lo"]) / bins)).cast("int"), F.lit(bins - 1))))
    shares = _let(binned, lambda b: F.transform(F.array(*[F.lit(k) for k in range(bins)]), lambda k: F.size(F.filter(b, lambda v: v == k)) / F.size(b)))
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.when(F.array_min(x) == F.array_max(x), 0.0).otherwise(bits)


def add_entropy(d: DataFrame) -> DataFrame:
    """Entropy of returns and of log volume over 20 and 60 rows; 0 until half of the window is there."""
    d = d.withColumn("_ret", _zero(F.col("return"))).withColumn("_vol", F.col("log_volume"))
    names = [(x, n) for x in ("ret", "vol") for n in (20, 60)]
    d = d.withColumns({f"_{x}{n}": F.collect_list(f"_{x}").over(trailing(n)) for x, n in names})
    return _tidy(d.withColumns({
        f"{x}_entropy_{n}d": F.when(F.size(f"_{x}{n}") >= max(n // 2, 5), entropy(F.col(f"_{x}{n}"))).otherwise(0.0) for x, n in names
    }))


def hurst_exponent(x: np.ndarray) -> float:
    """Slope of log rescaled range on log chunk size, clipped to 0 and 1; 0.5 if under two sizes have 10 rows."""
    sizes = [s for s in (int(len(x) * f) for f in (0.1, 0.2, 0.3, 0.5)) if s >= 10]
    if len(sizes) < 2:
        return 0.5
    logs = []
    for s in sizes:
        chunk = x[: len(x) // s * s].reshape(-1, s)
        walk = np.cumsum(chunk - chunk.mean(axis=1, keepdims=True), axis=1)
        sd = chunk.std(axis=1)
        ratio = np.ptp(walk, axis=1) / np.where(sd == 0, 1e-9, sd)
        logs.append(np.log(np.where(ratio == 0, 1e-9, ratio).mean()))
    return float(np.clip(np.polyfit(np.log(sizes), logs, 1)[0], 0.0, 1.0))


@functools.cache
def _hurst_udf():
    def run(windows: pd.Series) -> pd.Series:
        return windows.map(hurst_exponent)

    return F.pandas_udf(run, "double")


def add_hurst(d: DataFrame) -> DataFrame:
    """Hurst exponent over 20 and 60 rows. At 20 rows a single chunk size is left, so it is 0.5 throughout."""
    d = d.withColumn("_r", _zero(F.col("return"))).withColumns({f"_h{n}": F.collect_list("_r").over(trailing(n)) for n in (20, 60)})
    return _tidy(d.withColumns({f"hurst_{n}d": _hurst_udf()(f"_h{n}") for n in (20, 60)}))


def add_signal_features(d: DataFrame, k_up: float = 0.8, k_move: float = 1.0) -> DataFrame:
    """Probabilities of a rise and of a large move from the 5-row return in units of volatility, and their blend."""
    d = d.withColumn("_m5", change("close", 5))
    d = d.withColumns({
        "_z": F.abs(w.clip(_zero(F.when(F.col("volatility_21").isNotNull(), F.col("_m5") / F.greatest(F.col("volatility_21"), F.lit(1e-8)))), -3.0, 3.0)),
        "_rsi": _zero((F.col("rsi") - 50) / 50),
    })
    d = d.withColumns({
        "eb_prob_up": 1 - F.exp(-w.clip(F.col("_z") * (1 + F.abs("_rsi")) * k_up, 0.0, 30.0)),
        "eb_prob_large_move": 1 - F.exp(-w.clip(F.col("_z") / 0.02 * k_move, 0.0, 30.0)),
        "eb_prob_combined": F.when(F.col("volatility_21").isNotNull(), w.clip(0.5 + F.col("_rsi") * 0.1 - F.col("volatility_21") * 0.05, 0.05, 0.95)),
    })
    return _tidy(d.withColumn("eb_signal", 0.4 * F.col("eb_prob_up") + 0.3 * F.col("eb_prob_large_move") + 0.3 * F.col("eb_prob_combined")))


def add_labels(d: DataFrame, horizon: int = 5, rise: float = 0.02) -> DataFrame:
    """Forward labels. ``target``: 1 if the close ``horizon`` rows ahead is over ``rise`` higher, null without a future."""
    ahead = F.try_divide(w.lead("close", horizon), F.col("close")) - 1
    w10 = w.series().rowsBetween(1, 10)
    return d.withColumns({
        "future_return": ahead, "target": F.when(ahead.isNotNull(), (ahead > rise).cast("int")),
        "future_vol_10": F.when(F.count("return").over(w10) == 10, F.stddev_samp("return").over(w10)),
        "next_return": w.lead("return", 1),
    } | {f"direction_{h}": F.when(w.lead("close", h).isNotNull(), (w.lead("close", h) > F.col("close")).cast("int")) for h in (1, 3, 5, 10, 20)})


def regime(ret: Column, vol: Column, vix: Column, move: float = 0.05 / 60, calm: float = 0.20, bull: float = 20.0, bear: float = 30.0) -> Column:
    """bull, bear or neutral of a row. Missing or zero volatility counts as 0.20, a missing VIX as 25."""
    s = F.when(vol.isNull() | (vol == 0), 0.20).otherwise(vol)
    x = F.coalesce(vix, F.lit(25.0))
    return (
        F.when((ret >= move) & (s <= calm) & (x <= bull), "bull")
        .when((ret < 0) & (s >= calm * 0.8) & (x >= bear * 0.7), "bear")
        .otherwise("neutral")
    )


def terciles(d: DataFrame, x: str, train: Column, key: str = "ticker") -> DataFrame:
    """Tercile (low, mid, high) of ``x`` by cut points of the training rows of each key."""
    # The places of the cuts in each key's order; a key's values are sorted, not held.
    order = W.partitionBy(key).orderBy(x)
    some = d.filter(train).filter(F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.row_number().over(order).alias("_n"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("_all"))

    def cut(share: float) -> Column:
        at = (F.col("_all") - 1) * share
        low, high = (F.max(F.when(F.col("_n") == F.floor(at) + k, F.col("_x"))) for k in (1, 2))
        return low + F.coalesce(high - low, F.lit(0.0)) * F.max(at - F.floor(at))

    cuts = some.groupBy(key).agg(F.array(cut(1 / 3), cut(2 / 3)).alias("_cut"))
    label = F.when(F.col(x) <= F.col("_cut")[0], "low").when(F.col(x) <= F.col("_cut")[1], "mid").when(F.col(x).isNotNull(), "high")
    return d.join(cuts, key, "left").withColumn(f"{x}_regime", label).drop("_cut")


def add_drawdown(d: DataFrame, x: str = "close") -> DataFrame:
    """Running peak and drawdown."""
    d = d.withColumn("peak", F.max(x).over(w.cumulative()))
    return d.withColumn("drawdown", F.try_divide(F.col(x), F.col("peak")) - 1)


def drop_warm_up(d: DataFrame, *columns: str) -> DataFrame:
    return d.dropna(how="any", subset=list(columns) or None)
