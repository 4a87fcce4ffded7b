import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldrift.operators import indicators as ind
from veldrift.operators import sentiment

BASE = ["return", "volatility", "rsi", "ma_50", "momentum_63", "lag_20", "volatility_21"]


def bars(n=300, seed=42, ticker="A"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    t = pd.bdate_range("2020-01-01", periods=n)
    return pd.DataFrame({"ticker": ticker, "timestamp": t.date, "open": close + rng.normal(0, 0.5, n), "high": close + 1 + rng.random(n), "low": close - 1 - rng.random(n), "close": close, "volume": rng.integers(1_000_000, 5_000_000, n).astype(float)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf, "ticker string, timestamp date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def base(spark):
    pdf = bars()
    return pdf, ind.add_base(frame(spark, pdf)).toPandas().sort_values("timestamp").reset_index(drop=True)


def test_base_against_pandas(base):
    pdf, got = base
    r = pdf.close.pct_change()
    d = pdf.close.diff()
    up, down = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    expected = {
        "return": r, "volatility": r.rolling(20).std(), "ma_50": pdf.close.rolling(50).mean(), "ma_200": pdf.close.rolling(200).mean(),
        "momentum_63": pdf.close.pct_change(63), "lag_20": r.shift(20), "rsi": 100 - 100 / (1 + up / (down + 1e-9)),
    }
    for c, e in expected.items():
        np.testing.assert_allclose(got[c].astype(float), e, rtol=1e-9, atol=1e-12, equal_nan=True)
    assert got.rsi.first_valid_index() == 13 and got.rsi.dropna().between(0, 100).all()


def test_flat_series_do_not_fail(spark):
    pdf = bars(80).assign(open=5.0, high=5.0, low=5.0, close=5.0, volume=7.0)
    d = ind.add_base(frame(spark, pdf))
    got = ind.add_entropy(ind.add_moments(ind.add_microstructure(ind.add_derived(d)))).toPandas().sort_values("timestamp")
    assert (got.rsi.dropna() == 0).all() and (got.ret_entropy_20d == 0).all() and got.bollinger_position.isna().all()
    assert got.skew_ret_20d.iloc[-1] == 0 and got.kurt_ret_20d.iloc[-1] == -3 and got.vol_price_corr.iloc[-1] == 0


def test_features_do_not_see_the_future(spark):
    pdf = bars()
    changed = pdf.copy()
    changed.loc[200:, ["open", "high", "low", "close"]] *= 3
    run = lambda p: ind.add_har(ind.add_moments(ind.add_microstructure(ind.add_base(frame(spark, p))))).toPandas().sort_values("timestamp").reset_index(drop=True)
    a, b = run(pdf), run(changed)
    pd.testing.assert_frame_equal(a.iloc[:200], b.iloc[:200])
    assert not a.iloc[200:].equals(b.iloc[200:])


def test_many_series_at_once_equal_one_by_one(spark):
    two = pd.concat([bars(seed=1), bars(seed=2, ticker="B")])
    both = ind.add_base(frame(spark, two)).filter("ticker = 'B'").toPandas().sort_values("timestamp").reset_index(drop=True)
    one = ind.add_base(frame(spark, bars(seed=2, ticker="B"))).toPandas().sort_values("timestamp").reset_index(drop=True)
    pd.testing.assert_frame_equal(both, one)


def test_moments_against_pandas(spark):
    pdf = bars(120)
    got = ind.add_moments(ind.add_base(frame(spark, pdf))).toPandas().sort_values("timestamp").reset_index(drop=True)
    r = pdf.close.pct_change().fillna(0)
    np.testing.assert_allclose(got.skew_ret_20d, r.rolling(20, min_periods=10).skew().fillna(0), atol=1e-9)
    np.testing.assert_allclose(got.kurt_ret_60d, r.rolling(60, min_periods=30).kurt().fillna(0), atol=1e-8)
    np.testing.assert_allclose(got.ret_std_10d, r.rolling(10, min_periods=1).std().fillna(0), atol=1e-12)


def test_hurst_is_half_at_20_rows(spark):
    got = ind.add_hurst(ind.add_base(frame(spark, bars(120)))).toPandas().sort_values("timestamp")
    assert (got.hurst_20d == 0.5).all()
    assert (got.hurst_60d.iloc[:33] == 0.5).all() and got.hurst_60d.between(0, 1).all() and got.hurst_60d.iloc[-1] != 0.5


def test_labels_leave_the_last_rows_out(spark):
    got = ind.add_labels(ind.add_base(frame(spark, bars(60)))).toPandas().sort_values("timestamp")
    assert got.target.isna().sum() == 5 and got.target.tail(5).isna().all()
    assert got.future_vol_10.isna().sum() == 10  # rows 1 to 10 ahead must all be there


def test_regimes(spark):
    rows = [(0.01, 0.1, 15.0, "bull"), (-0.01, 0.2, 25.0, "bear"), (-0.01, 0.1, 25.0, "neutral"), (0.01, None, None, "neutral"), (-0.01, 0.0, None, "bear"), (None, 0.1, 10.0, "neutral")]
    d = spark.createDataFrame(rows, "r double, v double, x double, expected string")
    got = d.select("expected", ind.regime(F.col("r"), F.col("v"), F.col("x")).alias("g")).collect()
    assert all(r.expected == r.g for r in got)


def test_expressions_over_missing_columns_are_skipped(spark):
    d = spark.createDataFrame([(2.0, 3.0)], "`return` double, b double")
    out = ind.evaluate(d, {"x": "return * b", "y": "return * c"})
    assert out.columns == ["return", "b", "x"] and out.first().x == 6.0


def test_sentiment_score(spark):
    rows = [(1, "A", datetime.date(2024, 1, 1), "Bullish rally!", None), (2, "A", datetime.date(2024, 1, 1), None, "crash"), (3, "A", datetime.date(2024, 1, 2), "", "")]
    n = spark.createDataFrame(rows, "doc_id long, ticker string, date date, title string, body string")
    got = {r.doc_id: r for r in sentiment.score(n).collect()}
    assert got[1].n_positive == 2 and math.isclose(got[1].compound, 4.8 / math.sqrt(4.8**2 + 15))
    assert got[2].delta == -1 and got[3].compound == 0
    day = {r.date.day: r for r in sentiment.daily(sentiment.score(n)).collect()}
    assert day[1].n == 2 and math.isclose(day[1].compound, (got[1].compound + got[2].compound) / 2)
