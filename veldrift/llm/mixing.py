"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources share the budget by weight; no source is taken more than ``max_epochs`` times, and what that leaves over is
shared again by weight. Within a source every document is expected ``target / source_size`` times. The prefix sum of
these expected copies, plus one random offset, crosses integers, and a document is taken once for each crossing.
Documents come in order of size, so the words taken keep close to the target.

The prefix sum is in three levels (source and size class, size, then a salt of doc_id), so no task holds a source: a
class has at most ``CLASS * (SALTS + 1)`` counts, whatever the input, and a source as many classes as its longest document
needs.

Defined results: null text has size 0; null source is a source, last in order; a source of size 0 has target 0; an empty
table gives no rows; rows that repeat are sampled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored, word_count

SALTS = 64
WEIGHTS = (5, 2, 1)
#: Sizes in a class of the middle level.
CLASS = 256


def _plus(*cols: Column) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).cast("long") for c in cols]


def _all(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Target of each source: (source, source_size, target), from one row per source (source, source_size).

    Weights repeat over the sources in code-point order, null last. Sources fill in the order of
    source_size / weight: a source is full when the budget covers the full ones so far and every other one at the same
    level. The table has one row per source.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    upto = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(1))
    t = (
        t.withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_upto", F.sum("cap").over(upto))
        .withColumn("w_upto", F.sum("w").over(upto))
        .withColumn("full", F.col("cap_upto") * F.col("w") + F.col("cap") * (F.col("all_w") - F.col("w_upto")) <= F.col("total") * F.col("w"))
    )
    t = t.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)).withColumn(
        "w_full", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(every)
    )
    share = F.try_divide(((F.col("total") - F.col("cap_full")) * F.col("w")).cast("double"), F.col("all_w") - F.col("w_full"))
    return t.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return copies_of(narrow, weights, max_epochs, seed)


def copies_of(
    sizes: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """As ``copies``, from rows of doc_id, source, size; the columns ``keep`` are passed on."""
    d = sizes.select("doc_id", "source", "size", *keep, F.monotonically_increasing_id().alias("place"))
    d = d.select(
        "*", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.lit(-1)).cast("int").alias("salt"),
        F.floor(F.col("size") / CLASS).alias("class"),
    )
    d = stored(d, "sizes")
    key = ["none", "name"]
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    cells = d.groupBy(*key, "class", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells, "cells")
    classes = cells.groupBy(*key, "class").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = classes.groupBy(*key).agg(F.sum("words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    plan = targets(sizes, weights, max_epochs).select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target",
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 3), 16, 10).cast("double") / 4096).alias("offset"),
    )
    classes = classes.select(
        *key, "class", *[c.alias("class_at") for c in _plus(F.sum("n").over(before(*key).orderBy("class")))]
    )
    cells = (
        cells.select(*key, "class", "size", "salt", *[c.alias("cell_at") for c in _plus(F.sum("n").over(before(*key, "class").orderBy("size", "salt")))])
        .join(classes, [*key, "class"])
        .join(plan, key)
        .select(*key, "size", "salt", (F.col("class_at") + F.col("cell_at")).alias("at"), "source_size", "target", "offset")
    )
    rank = F.row_number().over(W.partitionBy(*key, "size", "salt").orderBy("doc_id", "place"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(F.col("offset") + expected * n)
    out = d.withColumn("rank", rank).join(cells, [*key, "size", "salt"])
    n = F.col("at") + F.col("rank")
    out = out.withColumn("copies", (crossed(n) - crossed(n - 1)).cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as it is taken, with its columns.

    Rows are found again by doc_id, source and text digest. Rows alike in all of these share their copies evenly.
    """
    id_, tag, n, m, row = fresh(docs, "id", "tag", "copies", "alike", "row")
    key = lambda f: {
        id_: F.coalesce(f["doc_id"].cast("string"), F.lit("")),
        tag: F.xxhash64(f["text"], f["source"]),
    }
    narrow = docs.select("doc_id", "text", "source")
    narrow = narrow.withColumns({"size": word_count(narrow["text"]), **key(narrow)}).drop("text")
    taken = stored(
        copies_of(narrow, weights, max_epochs, seed, keep=(id_, tag))
        .groupBy(id_, tag).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(m)).filter(F.col(n) > 0),
        "taken",
    )
    out = docs.withColumns(key(docs)).join(taken, [id_, tag])
    if not taken.filter(F.col(m) > 1).isEmpty():
        again = out.filter(F.col(m) > 1).withColumn(row, F.row_number().over(W.partitionBy(id_, tag).orderBy(F.to_json(F.struct(*_all(docs))))))
        again = again.withColumn(n, F.floor(F.col(n) / F.col(m)) + (F.col(row) <= F.col(n) % F.col(m)).cast("int")).drop(row)
        out = out.filter(F.col(m) == 1).unionByName(again)
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*_all(docs))
