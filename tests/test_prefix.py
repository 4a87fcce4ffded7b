from itertools import accumulate

from veldrift.functions.prefix import running_sum


def test_ranges_give_the_same_sums_as_one_task(spark):
    rows = [(float((i * 7919) % 1009), i % 5) for i in range(1009)]
    d = spark.createDataFrame(rows, "x double, n long").repartition(4)
    expected = list(accumulate(n for _, n in sorted(rows)))
    for alone in (10_000, 10):
        got = [r.s for r in running_sum(d, "x", "n", "s", alone).orderBy("x").collect()]
        assert got == expected


def test_empty(spark):
    d = spark.createDataFrame([], "x double, n long")
    assert running_sum(d, "x", "n", "s").count() == 0
