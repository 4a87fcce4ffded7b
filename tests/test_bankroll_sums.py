"""Running sums bit for bit as DuckDB's windows add them, in one piece and in many, and the bankroll's beside its SQL."""

import math

import duckdb
import numpy as np

from veldrift.functions.prefix import TreeSum
from veldrift.operators import staking


def test_sums_equal_the_window_of_the_sql():
    x = np.random.default_rng(5).normal(size=70_001)
    con = duckdb.connect()
    con.register("t", {"i": np.arange(len(x)), "x": x})
    expected = con.execute("select sum(x) over (order by i rows unbounded preceding) as s from t order by i").fetchnumpy()["s"]
    for pieces in (1, 7, 1003):
        tree = TreeSum()
        got = np.concatenate([tree.push(p) for p in np.array_split(x, pieces)])
        assert (got == expected).all()


def test_bankroll_has_the_digits_of_the_sql(spark):
    """To the last bits but those of exp: exact sums, as before, part from the SQL's by up to ten times as much."""
    d = spark.range(120_000).selectExpr("if(id % 5 = 0, 'a', 'b') as k", "id as i", "if(id * 7919 % 100 < 45, 0.2D + id * 31 % 40 / 10D, -1D) as ret")
    rows = d.toPandas()
    con = duckdb.connect()
    con.register("t", rows)
    expected = con.execute("select i, 1000 * exp(sum(ln(1 + 0.01 * ret)) over (partition by k order by i rows unbounded preceding)) as b from t order by i").fetchnumpy()["b"]
    got = staking.trajectory(d, 0.01, "i", "k").orderBy("i").toPandas()
    assert max(abs(a / b - 1) for a, b in zip(got.bankroll, expected, strict=True)) < 1e-15
    top = {}
    for r in got.itertuples():
        top[r.k] = max(top.get(r.k, 1000.0), r.bankroll)
        assert r.peak == top[r.k] and (r.drawdown == 1 - r.bankroll / r.peak or math.isnan(r.drawdown))
