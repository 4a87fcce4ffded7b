"""Exact dedup with a log-structured merge index, in DataFrame functions only.

Each input partition is a memtable: its digests are sorted and flushed as a run, a Parquet file with a Bloom filter on
the digest. The runs' entries in a sparse filter (one bit of ``FILTER_BITS`` a row) are merged first: a row whose bit no
other row has set is alone, stays, and goes through no merge. The others are compacted level by level, ``FANOUT`` runs
into one, keeping the smallest identifier of each digest; an identifier orders rows, so the smallest one is the row that
stays. Digests that occur again are hits, and hits are verified on the bytes of their texts: all texts of a digest are
equal when the smallest is the largest. Digests that fail this (two texts, one digest) are grouped again by the text.

Defined results: null text counts as empty; null doc_id is below every other; of rows with the same text and doc_id one
stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Up to this many digests (8 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
#: Bits of the merged filter, and runs that a compaction merges into one.
FILTER_BITS = 2**40
FANOUT = 64
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}


def flush(docs: DataFrame, key: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Flush every partition of ``docs`` as one sorted run: digest, its bit, identifier, doc_id, sha256 of the key text.

    ``ident`` sorts rows that stay first: doc_id descending with null last, then the row's place.
    """
    rows = docs.select("doc_id", key.alias("key")).select(
        "doc_id",
        digest(F.col("key")).alias("digest"),
        F.sha2(F.encode("key", "UTF-8"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("place"),
        F.spark_partition_id().alias("run"),
    )
    rows = rows.select(
        "digest", "run", F.pmod("digest", F.lit(FILTER_BITS)).alias("bit"), "doc_id", "text_sha256",
        F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "place").alias("ident"),
    )
    return stored(rows.sortWithinPartitions("digest", "ident"), "run", **BLOOM)


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs, ``FANOUT`` into one at each level: digest, the smallest identifier, its doc_id, rows."""
    level = runs.select("run", "digest", F.struct("ident", "doc_id").alias("least"), F.lit(1).cast("long").alias("group_size"))
    most = runs.agg(F.max("run")).first()[0] or 0
    while True:
        most //= FANOUT
        level = level.withColumn("run", F.floor(F.col("run") / FANOUT).cast("int")) if most else level.withColumn("run", F.lit(0))
        level = level.groupBy("run", "digest").agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))
        if not most:
            return level.drop("run")
        level = stored(level, "level")


def _only(docs: DataFrame, keys: DataFrame, kind: str = "left_semi") -> DataFrame:
    """Rows whose key (the one column of ``keys``) is listed, or is not (``left_anti``)."""
    few = keys.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    return docs.join(F.broadcast(keys) if few else keys, keys.columns, kind)


def mark_duplicates(
    docs: DataFrame,
    key: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the text that ``key`` gives)."""
    text = F.coalesce(key(F.col("text")), F.lit(""))
    runs = flush(docs, text, digest)
    shared = stored(runs.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bit"), "filter")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = _only(runs, shared, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    runs = stored(_only(runs, shared), "probed")
    index = stored(compact(runs), "level", **BLOOM)
    hits = index.filter("group_size > 1").select("digest")
    texts = docs.select(text.alias("key")).select(digest(F.col("key")).alias("digest"), "key")
    clash = stored(
        _only(texts, hits).groupBy("digest").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        .filter("lo <> hi").select("digest"),
        "clash",
    )
    result = (
        runs.join(index, "digest")
        .withColumn("keep_id", F.col("least.doc_id"))
        .withColumn("kept", F.col("ident") == F.col("least.ident"))
    )
    if clash.isEmpty():
        return alone.unionByName(result.select(*out))
    result = alone.unionByName(result.join(clash, "digest", "left_anti").select(*out))
    odd = docs.select("doc_id", text.alias("key"), F.monotonically_increasing_id().alias("place")).select(
        "doc_id", "key", digest(F.col("key")).alias("digest"),
        F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "place").alias("ident"),
    )
    odd = stored(_only(odd, clash), "odd")
    groups = odd.groupBy("digest", "key").agg(
        F.min(F.struct("ident", "doc_id")).alias("least"), F.count(F.lit(1)).alias("group_size")
    )
    again = odd.join(groups, ["digest", "key"]).select(
        "doc_id", F.col("least.doc_id").alias("keep_id"), "group_size",
        (F.col("ident") == F.col("least.ident")).alias("kept"),
        F.sha2(F.encode("key", "UTF-8"), 256).alias("text_sha256"),
    )
    return result.unionByName(again)


def drop_duplicates(docs: DataFrame, key: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the largest doc_id.

    Rows to drop are found by (doc_id, sha256), which only they share; of repeated rows one is kept.
    """
    text = F.coalesce(key(F.col("text")), F.lit(""))
    marks = mark_duplicates(docs, key)
    drop = stored(
        marks.filter("group_size > 1").groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies")),
        "drop",
    )
    tagged = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"),
    )
    gone = drop.filter("not stays").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text_sha256").alias("sha"))
    few = gone.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    left = tagged.join(F.broadcast(gone) if few else gone, ["id", "sha"], "left_anti")
    repeated = drop.filter("stays and copies > 1").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text_sha256").alias("sha"))
    if not repeated.isEmpty():  # the same row more than once
        one = left.join(repeated, ["id", "sha"], "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(repeated, ["id", "sha"], "left_anti").select("row").union(one.select("row"))
    return left.select("row.*")
