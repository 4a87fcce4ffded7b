"""Queries that must take every row of their table."""

import pytest
from pyspark.sql import functions as F

from veldrift.plans import catalog
from veldrift.plans.adapters import bets

from .conftest import SMALL


def test_signal_portfolio_takes_the_signals_of_all_days(spark):
    signalled = bets(spark, SMALL).filter("bet_signal")
    assert signalled.select("date").distinct().count() > 1
    got = catalog.queries()["signal_portfolio"](spark, SMALL)
    assert sorted(r.bet_id for r in got.collect()) == sorted(r.bet_id for r in signalled.collect())
    assert got.agg(F.sum("weight")).first()[0] == pytest.approx(1, abs=1e-9)
