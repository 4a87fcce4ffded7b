"""Row and join operators on odd keys, against their SQL."""

import duckdb

from veldrift.operators import relational
from veldrift.plans.relational import R

from .conftest import SMALL


def test_not_in_as_sql_has_it(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    for rows in ([], [2, 2], [2, None]):
        other = spark.createDataFrame([(x,) for x in rows], "b long")
        got = {r.a for r in relational.not_in(left, "a", other, "b").collect()}
        con = duckdb.connect()
        con.execute("create table l as select unnest([1, 2, null])::bigint as a")
        con.execute("create table r (b bigint)")
        for x in rows:
            con.execute("insert into r values (?)", [x])
        assert got == {r[0] for r in con.execute("select a from l where a not in (select b from r)").fetchall()}


def test_anti_join_takes_every_order(spark):
    """No customer with an order of any price stays."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_custkey").distinct()
    got = R.queries["anti_join"](spark, SMALL)
    assert got.join(orders, got.c_custkey == orders.o_custkey, "left_semi").isEmpty()
    assert "o_totalprice" not in R.sql["anti_join"]
