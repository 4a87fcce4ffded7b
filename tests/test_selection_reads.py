"""Features are computed once, however many models look at them."""

from pyspark.sql import functions as F

from veldrift.operators import learning, selection


def test_ablation_computes_its_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    names = [*learning.HAR, "future_vol_10", "persistence_10"]
    rows = spark.range(300).select(F.lit("A").alias("ticker"), F.timestamp_seconds("id").alias("timestamp"), *[(F.rand(i) + 0.1).alias(c) for i, c in enumerate(names)])
    d = rows.mapInPandas(count, rows.schema)
    got = selection.volatility_ablation(d, {"har": learning.HAR[:3], "all": learning.HAR}, trees=2).collect()
    assert len(got) == 3 and seen.value == 300
