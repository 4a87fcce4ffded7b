import pytest
from pyspark.sql import functions as F

from veldrift.plans import catalog

from .conftest import SMALL
from .differential import check, connect

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    check(spark, SMALL, catalog.queries()[name], SQL[name], con)


#: Queries whose values depend on seeds or algorithms, with what their rows must hold.
BOUNDS = {
    "shap_importance": "mean_abs_shap >= abs(mean_shap) - 1e-12 and mean_abs_shap between 0 and 1 and n > 0 and rank between 1 and 14",
    "tpe_search": "auc between 0.3 and 1 and parameters like 'mix=%, reg=%'",
    "pooled_routing": "auc_own between 0 and 1 and auc_pool between 0 and 1 and (route = 'pool') = (auc_own < 0.55 and auc_pool > auc_own)",
    "efficient_frontier": "volatility > 0 and weight between 0 and 0.600000001 and abs(sharpe - target / volatility) < 1e-9",
    "boosted_by_leaves": "auc between 0.5 and 1 and brier between 0 and 0.25 and majority >= 0.5",
    "smote": "label in (0, 1) and `return` is not null and rsi between 0 and 100",
    "structured_chunks": "doc_id is not null and char_len between 1 and 1000 and length(file_hash) = 16",
    "risk_of_ruin": "p_ruin between 0 and 1 and p_dd50 <= p_dd30 and p5_final <= median_final and median_final <= p95_final and length(report) > 50",
    "safe_fraction": "share between 0 and 1 and fraction > 0 and p_dd30 between 0 and 0.1",
    "signal_portfolio": "weight between 0 and 1 and stake <= 1500",
    "forest_classifier": "auc between 0.5 and 1 and brier between 0 and 0.25 and majority >= 0.5",
    "elastic_net_classifier": "auc between 0.5 and 1 and brier between 0 and 0.25",
    "latest_predictions": "p between 0 and 1 and up = (p >= 0.5) and route in ('own', 'pool')",
    "cvar_drawdown": "cvar >= value_at_risk and cvar between 0 and 1",
    "max_sharpe_weights": "weight between 0 and 1",
}


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_query_keeps_its_bounds(spark, name):
    got = catalog.queries()[name](spark, SMALL)
    ok = got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"cast(coalesce({BOUNDS[name]}, false) as int)")).alias("ok")).first()
    assert ok.n > 0 and ok.ok == ok.n


def test_hurst_exponents_match_their_definition(spark):
    from veldrift.operators.indicators import hurst_exponent
    from veldrift.plans.features import base

    got = {(r.ticker, r.timestamp): (r.hurst_20d, r.hurst_60d) for r in catalog.queries()["hurst_features"](spark, SMALL).collect()}
    bars = base(spark, SMALL).select("ticker", "timestamp", F.coalesce("return", F.lit(0.0)).alias("r")).orderBy("ticker", "timestamp").toPandas()
    for ticker, d in bars.groupby("ticker"):
        for i in range(0, len(d), 37):
            expected = hurst_exponent(d.r.to_numpy()[max(0, i - 59) : i + 1])
            assert got[ticker, d.timestamp.iloc[i]] == (0.5, pytest.approx(expected, abs=1e-6))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
