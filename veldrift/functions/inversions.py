"""Pairs of rows in opposite order, counted in n log n over ranges of both columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import written


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight products of the pairs i < j with y[i] > y[j]: merging runs of doubled length, all runs at once."""
    n = len(y)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    weight = weight.astype(np.int64)
    span = int(rank.max(initial=0)) + 1
    total, width = 0, 1
    while width < n:
        at = np.arange(n)
        block, right = at // (2 * width), at // width % 2 == 1
        # Left halves are sorted by block and rank: what is greater than a right row's rank is at the end of its block.
        key = block * span + rank
        left = key[~right]
        upto = np.append(0, np.cumsum(weight[~right]))
        end = np.searchsorted(left, (block[right] + 1) * span, "left")
        start = np.searchsorted(left, key[right], "right")
        total += int(((upto[end] - upto[start]) * weight[right]).sum())
        order = np.argsort(key, kind="stable")
        rank, weight = rank[order], weight[order]
        width *= 2
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, y, n) sorted by part and the order within, to one sum of inversions for each part."""
    parts: list[int] = []
    sums: list[str] = []
    held: list[pa.RecordBatch] = []
    now = None

    def close() -> None:
        if held:
            y, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("y", "n"))
            parts.append(now)
            sums.append(str(inversions(y, n)))
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if part[a] != now:
                close()
                now = int(part[a])
            held.append(batch.slice(a, b - a))
    close()
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sums, pa.string())], ["part", "s"])


def discordant(counts: DataFrame, rows: int = 500_000) -> int:
    """The number of pairs of rows with x < x' and y > y', of different values (x, y) with their number n.

    The values are dealt by ranges of (x, y), and by ranges of y; about ``rows`` different values make a range. Pairs of one
    x range are counted by merging there. Of two x ranges, pairs of different y ranges follow from the numbers of rows by x
    and y range, and those of one y range are counted by merging the x ranges there. A y range of a single y has none.
    """
    size = counts.count()
    if size < 2:
        return 0
    ranges = max(1, -(-size // rows))
    d = written(counts.repartitionByRange(ranges, "x", "y").withColumn("xr", F.spark_partition_id()), "by_x")
    d = written(d.repartitionByRange(ranges, "y").withColumn("yr", F.spark_partition_id()), "by_y")

    def within(part: str, of: DataFrame, *order: str) -> int:
        sorted_ = of.withColumn("part", F.col(part)).repartition("part").sortWithinPartitions("part", *order)
        found = sorted_.select("part", F.col("y").cast("double").alias("y"), F.col("n").cast("long").alias("n")).mapInArrow(_count, "part int, s string")
        return sum(int(r.s) for r in found.collect())  # a row for each range

    total = within("xr", d, "x", "y")
    if ranges == 1:
        return total
    several = d.groupBy("yr").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("lo < hi").select("yr")
    total += within("yr", d.join(F.broadcast(several), "yr"), "xr", "y")
    grid = np.zeros((ranges, ranges), object)
    for r in d.groupBy("xr", "yr").agg(F.sum("n").alias("n")).collect():  # a row for each pair of ranges
        grid[r.xr, r.yr] = r.n
    after = np.cumsum(grid[::-1], axis=0)[::-1]  # rows of this x range and later ones
    for x in range(ranges - 1):
        lower = np.cumsum(after[x + 1])  # rows of later x ranges, up to each y range
        total += sum(int(grid[x, y]) * int(lower[y - 1]) for y in range(1, ranges) if grid[x, y])
    return total
