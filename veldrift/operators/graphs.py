"""Graph aggregates over nodes (id, label, type, community) and edges (source, target), and a keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops: (id, neighbour)."""
    e = edges.filter("source <> target")
    both = e.select(F.col("source").alias("id"), F.col("target").alias("neighbour")).unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("neighbour")))
    return both.distinct()


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """The nodes of most neighbours with at least ``least``: n_children, counts by type, dominant community."""
    adj = adjacency(edges)
    best = degrees(adj).filter(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(top)
    kinds = nodes.select(F.col("id").alias("neighbour"), F.coalesce("type", F.lit("unknown")).alias("child_type"), "community")
    children = adj.join(F.broadcast(best), "id").join(kinds, "neighbour", "left")
    types = children.groupBy("id", F.coalesce("child_type", F.lit("unknown")).alias("t")).count()
    types = types.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "t", F.col("count").cast("string")))), ",").alias("child_types"))
    comms = children.filter("community is not null").groupBy("id", "community").count()
    w = W.partitionBy("id").orderBy(F.desc("count"), "community")
    dominant = comms.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", F.col("community").alias("dominant_community"))
    return best.join(types, "id", "left").join(dominant, "id", "left").join(nodes.select("id", "label", "type"), "id", "left").withColumnRenamed("degree", "n_children")


def correlated_children(nodes: DataFrame, edges: DataFrame, parents: DataFrame, top: int = 5, cap: int = 200) -> DataFrame:
    """Pairs of children of each parent by Jaccard overlap of their neighbours, plus 0.5 if adjacent: (id, a, b, score,
    shared). At most ``cap`` children of a parent, of most neighbours, are compared: that bound is the operator's own."""
    adj = adjacency(edges)
    deg = degrees(adj)
    children = adj.join(F.broadcast(parents.select("id")), "id").join(deg.select(F.col("id").alias("neighbour"), "degree"), "neighbour")
    w = W.partitionBy("id").orderBy(F.desc("degree"), "neighbour")
    children = children.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    c = children.select("id", F.col("neighbour").alias("c"), F.col("degree").alias("d"), "_n")
    a, b = c.toDF("id", "a", "da", "na"), c.toDF("id", "b", "db", "nb")
    pairs = a.join(b, "id").filter("na < nb")
    # Common neighbours by way of the neighbours of a that b has too.
    via = adj.toDF("a", "x")
    has = adj.toDF("b", "x").withColumn("hit", F.lit(1))
    shared = pairs.join(via, "a").join(has, ["b", "x"]).groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    direct = adj.toDF("a", "b").withColumn("adjacent", F.lit(0.5))
    out = pairs.join(shared, ["id", "a", "b"], "left").join(direct, ["a", "b"], "left")
    n = F.coalesce("shared", F.lit(0))
    score = n / (F.col("da") + F.col("db") - n) + F.coalesce("adjacent", F.lit(0.0))
    out = out.select("id", "a", "b", score.alias("score"), n.alias("shared")).filter("score > 0")
    w = W.partitionBy("id").orderBy(F.desc(F.round("score", 9)), F.desc("a"), F.desc("b"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def prune(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, ids: list[str] | None = None, drop_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given types and ids, and optionally without nodes that keep no edge."""
    gone = F.coalesce(F.col("type").isin(types or []), F.lit(False)) | F.col("id").isin(ids or [])
    kept = nodes.filter(~gone)
    dead = nodes.filter(gone).select("id")
    e = edges.join(dead.withColumnRenamed("id", "source"), "source", "left_anti").join(dead.withColumnRenamed("id", "target"), "target", "left_anti")
    if drop_isolated:
        ends = e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).distinct()
        kept = kept.join(ends, "id", "left_semi")
    return kept, e.select("source", "target")


def prune_stats(nodes: DataFrame, edges: DataFrame, kept: DataFrame, left: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(nodes, "n0").crossJoin(n(edges, "e0")).crossJoin(n(kept, "nodes_remaining")).crossJoin(n(left, "edges_remaining"))  # single rows
    return out.select((F.col("n0") - F.col("nodes_remaining")).alias("nodes_removed"), (F.col("e0") - F.col("edges_remaining")).alias("edges_removed"), "nodes_remaining", "edges_remaining")


# A keyed store: entries (kind, key, scope, value, created, accessed, access_count, ttl), times in seconds


def latest(writes: DataFrame) -> DataFrame:
    """Upsert: the last write of each (kind, key)."""
    w = W.partitionBy("kind", "key").orderBy(F.desc("created"), F.desc("value"))
    return writes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def touch(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """Access counters and times after reads (kind, key, at)."""
    r = reads.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_reads"), F.max("at").alias("_last"))
    d = entries.join(r, ["kind", "key"], "left")
    return d.withColumns({"access_count": F.col("access_count") + F.coalesce("_reads", F.lit(0)), "accessed": F.greatest("accessed", F.coalesce("_last", F.col("accessed")))}).drop("_reads", "_last")


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone, ["kind", "key"], "left_anti")


def search(entries: DataFrame, text: str, kind: str | None = None, scope: str | None = None, limit: int = 10) -> DataFrame:
    hit = F.lower("key").contains(text.lower()) | F.lower("value").contains(text.lower())
    d = entries.filter(hit)
    d = d if kind is None else d.filter(F.col("kind") == kind)
    d = d if scope is None else d.filter(F.col("scope") == scope)
    return d.orderBy(F.desc("accessed"), "kind", "key").limit(limit)


def alive(now: float) -> Column:
    return now - F.col("created") <= F.col("ttl")


def evict(entries: DataFrame, now: float, most: int) -> DataFrame:
    """Without the expired, and of the rest the ``most`` last accessed: a sort with a limit, not a ranking of all."""
    return entries.filter(alive(now)).orderBy(F.desc("accessed"), "kind", "key").limit(most)


def decay(entries: DataFrame, now: float, factor: float = 0.5, least: int = 1, after: float = 3600.0, floor: int = 300) -> DataFrame:
    old = (F.col("access_count") < least) & (now - F.col("created") > after)
    return entries.withColumn("ttl", F.when(old, F.greatest(F.lit(floor), F.floor(F.col("ttl") * factor).cast("int"))).otherwise(F.col("ttl")))


def ranked(entries: DataFrame, now: float, k: int = 10) -> DataFrame:
    """The k best by 0.6 * (1 - recency) + 0.4 * min(1, accesses / 10)."""
    recency = (now - F.col("accessed")) / F.greatest(F.col("ttl"), F.lit(1))
    score = (1 - recency) * 0.6 + F.least(F.lit(1.0), F.col("access_count") / 10) * 0.4
    return entries.filter(alive(now)).withColumn("score", score).orderBy(F.desc(F.round("score", 9)), "kind", "key").limit(k)


def counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
