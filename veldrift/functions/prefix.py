"""Running sums over a whole table's order, without a task that holds all rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one task may sort; more are summed by ranges of the order.
ALONE = 1_000_000


#: The session's setting for a folder of this machine, used only in local mode without a checkpoint folder.
LOCAL_SCRATCH = "veldrift.local.scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint
    folder. Where neither is set, a new folder of this machine, but only if Spark runs in this one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_SCRATCH, None)
    if not base:
        held = spark._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(LOCAL_SCRATCH, base)
    return f"{base.rstrip('/')}/veldrift/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: str, value: str, name: str, alone: int = ALONE) -> DataFrame:
    """Adds the sum of ``value`` over the rows before and at each row; rows must differ in ``order``.

    Beyond ``alone`` rows the table is dealt out by ranges of the order and written once; ranges are summed each, and
    one small table has the sums before each range.
    """
    upto = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    if df.limit(alone + 1).count() <= alone:
        return df.withColumn(name, F.sum(value).over(upto))
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    d = df.sparkSession.read.parquet(path)
    sums = d.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_range", before.alias("_before"))  # one row per range
    inner = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.sum(value).over(inner)).drop("_range", "_before")


class TreeSum:
    """Running sums of doubles that come in pieces, added as DuckDB adds in a window from the first row on: nodes of 16 values,
    of 16 nodes and so on; a sum takes its largest whole nodes first. Errors grow with the depth, and bits equal the SQL's.
    """

    FANOUT = 16

    def __init__(self) -> None:
        self.start, self.part, self.above = 0.0, np.empty(0), None

    def push(self, x: np.ndarray) -> np.ndarray:
        """The sum up to and with each of ``x``, which follow the values so far."""
        old, k = len(self.part), self.FANOUT
        held = np.concatenate([self.part, np.asarray(x, float)])
        whole = len(held) // k
        rows = np.zeros((whole + 1, k))
        rows.reshape(-1)[: len(held)] = held
        starts, self.part = np.full(whole + 1, self.start), held[whole * k :]
        if whole:
            self.above = self.above or TreeSum()
            starts[1:] = self.above.push(np.cumsum(rows[:whole], axis=1)[:, -1])
            self.start = starts[-1]
        sums = np.cumsum(np.column_stack([starts, rows]), axis=1)[:, 1:]
        sums[:whole, -1] = starts[1:]
        return sums.reshape(-1)[old : len(held)]
