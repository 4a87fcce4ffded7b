import datetime

from pyspark.sql import functions as F

from veldrift.streaming import events

START = datetime.datetime(2024, 1, 1)
ROWS = [(i % 90, START + datetime.timedelta(hours=i % 90), i % 5, "ab"[i % 2], float(i % 7), "{}") for i in range(100)]


def source(spark, tmp_path):
    spark.createDataFrame(ROWS, events.EVENTS).repartition(2).write.parquet(str(tmp_path / "in"))
    return events.read_events(spark, str(tmp_path / "in"))


def test_repeated_events_count_once(spark, tmp_path):
    q = events.distinct(source(spark, tmp_path), late="30 days").writeStream.format("memory").queryName("distinct_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_events").count() == 90


def test_drift_by_batch_and_replay(spark, tmp_path):
    reference = spark.createDataFrame([(float(i),) for i in range(100)], "value double")
    write = events.drift_sink(reference, ["value"], str(tmp_path / "drift"))
    same, moved = reference, reference.withColumn("value", F.col("value") + 500)
    for batch, epoch in ((same, 0), (moved, 1), (moved, 1)):
        write(batch, epoch)
    got = {r.epoch: r for r in spark.read.parquet(str(tmp_path / "drift")).collect()}
    assert len(got) == 2 and got[0].verdict == "none" and got[1].verdict == "significant"
