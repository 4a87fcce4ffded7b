"""Streams of events: daily bars with a watermark, dedup, and drift per micro-batch. An extension of the batch library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of the Parquet files of a directory."""
    return spark.readStream.schema(schema).parquet(path)


def bars(events: DataFrame, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Open, high, low, close, count per type and window; rows later than the watermark are left out."""
    w = F.window("ts", width)
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    return agg.select("ticker", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def distinct(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, remembering identifiers for as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drift_sink(reference: DataFrame, names: list[str], table: str):
    """A foreachBatch function that appends each micro-batch's stability indices to a table; a batch that is replayed
    replaces its own rows."""
    from ..operators.profiling import psi

    def write(batch: DataFrame, epoch: int) -> None:
        both = reference.select(*names).withColumn("_r", F.lit(True)).unionByName(batch.select(*names).withColumn("_r", F.lit(False)))
        out = psi(both, names, F.col("_r"), ~F.col("_r")).withColumn("epoch", F.lit(epoch).cast("long"))
        out.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return write
