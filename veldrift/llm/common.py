"""Helpers shared by the training-data operators: shared scratch tables, text expressions, links to components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The session's setting for a folder of this machine, used only in local mode without a checkpoint folder.
LOCAL_SCRATCH = "veldrift.local.scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint
    folder. Where neither is set, a new folder of this machine is set for the session, but only if Spark runs in this
    one process."""
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


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables, and let Spark clean the shuffles that made them."""
    remove(spark, *paths)
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs that run within get at most so many rows in an Arrow batch: for rows of several kilobytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in ``lower``, which then does the same, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_chunks(texts: Iterable[bytes], limit: int = 4_000_000) -> Iterator[list[bytes]]:
    """Lists of whole texts, each of at most ``limit`` bytes unless one text alone is longer."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        if chunk and size + len(t) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def rows_with(rows: DataFrame, counts: DataFrame, on: list[str], n: str = "n", share: int = 1000) -> DataFrame:
    """``rows`` whose key is in ``counts`` (key and number of rows): a left semi join that no hot key can slow.

    Keys of over 1 / ``share`` of all counted rows, fewer than ``share``, are sent to every task; the others are shuffled.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = stored(counts.filter(F.col(n) > total / share).select(*on), "hot")
    if hot.isEmpty():
        return rows.join(counts.select(*on), on, "left_semi")
    usual = rows.join(F.broadcast(hot), on, "left_anti").join(counts.filter(F.col(n) <= total / share).select(*on), on, "left_semi")
    return rows.join(F.broadcast(hot), on, "left_semi").unionByName(usual)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of undirected ``edges`` (a, b; both long), as (node, component).

    Alternating large-star and small-star rounds. Each round is one aggregation by node and one join; every
    round is written to the shared folder, and only the number of changed edges reaches the driver. The count
    of edges never grows, and a hub's neighbours are pre-aggregated before the shuffle. An edge from a node to
    itself only names that node.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    at = scratch_path(spark, "edges")
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "", at)
    before = None
    for _ in range(max_rounds):
        least_at, next_at = scratch_path(spark, "least"), scratch_path(spark, "edges")
        both = cur.select("v", "u").union(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Written, so that the join meets two shuffles and a hub's rows can be split.
        least = stored(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "", least_at)
        # Large star: every greater neighbour of v moves to v's least neighbour.
        large = (
            both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        )
        # Small star: v and its lesser neighbours meet at the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .filter("u < v")
            .distinct()
        )
        cur = stored(small, "", next_at)
        remove(spark, at, least_at)
        at = next_at
        now = cur.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("v").agg(F.min("u").alias("component"))
    return (
        nodes.join(roots, nodes["node"] == roots["v"], "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


__all__ = [
    "WORD",
    "ascii_lower",
    "byte_chunks",
    "connected_components",
    "discard",
    "fresh",
    "remove",
    "rows_with",
    "scratch_path",
    "small_batches",
    "stored",
    "word_count",
]
