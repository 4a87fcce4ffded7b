"""Pairs of bets where one league and day holds nearly all: all of them, dealt over tasks."""

import itertools

from pyspark.sql import functions as F

from veldrift.operators import staking


def test_a_large_group_is_dealt_over_tasks(spark):
    """Without help by Spark's own plan changes, as a join of two large tables."""
    rows = [(i, "L" if i < 300 else f"M{i % 3}", "2024-01-01", 0.1 + i / 1000, i % 10 != 0) for i in range(330)] + [(400, None, "2024-01-01", 0.3, True), (401, None, "2024-01-01", 0.3, True)]
    bets = spark.createDataFrame(rows, "bet_id long, league string, date string, ev double, bet_signal boolean")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for most in (40, 10_000):
            got = staking.bet_correlation(bets, **({} if most == 10_000 else {"most": most})).withColumn("task", F.spark_partition_id()).collect()
            pairs = {(a[0], b[0]): (a[3] / 1.5) * (b[3] / 1.5) * 0.1 for a, b in itertools.combinations(rows, 2) if a[4] and b[4] and a[1] and a[1:3] == b[1:3]}
            assert sorted((r.bet_id, r.other) for r in got) == sorted(pairs)
            assert all(abs(r.cov - pairs[r.bet_id, r.other]) < 1e-15 for r in got)
            if most == 40:
                tasks = [r.task for r in got if r.bet_id < 300]
                assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_of_a_group_lie_together(spark):
    """In runs of one bet, so that a written file holds each once: a broadcast join left groups mixed in the table's order."""
    bets = spark.range(3000).selectExpr("id as bet_id", "concat('L', id % 50) as league", "'2024-01-01' as date", "0.1D as ev", "true as bet_signal")
    got = [(r.bet_id % 50, r.task) for r in staking.bet_correlation(bets).withColumn("task", F.spark_partition_id()).collect()]
    assert len(got) == 50 * 60 * 59 // 2
    assert sum(1 for _ in itertools.groupby(got)) == 50  # a league is one run of rows
