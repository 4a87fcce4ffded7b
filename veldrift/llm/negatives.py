"""Hard negatives by exact search of inverted lists.

K-means centroids are fit on a bounded sample; every row then goes to the list of its nearest centroid, and each list keeps
its radius, the largest distance of a row from the centroid. For a query q the scores of a list lie within
q.c - |q| r and q.c + |q| r (Cauchy-Schwarz). A query visits lists by falling upper bound, in rounds of growing length; it
skips lists outside its window of scores, and stops once the bound of the next list is strictly below its k-th score, so
ties are always seen. The result is that of scoring all rows.

Lists are kept in parts of bounded bytes and queries in blocks of bounded numbers. A task scores one block against one part
at a time, and hands on at most k rows of each window, so neither a crowded list nor a common vector makes a large group.
Scores are integers: a component x counts as floor(``scale`` * x).

Defined results: rows take no part if vec_id, label, the vector or one of its components is null, if a component is not
finite or is 2 ** 20 or more in size after scaling, or if the number of components is not the most frequent one (of several the
smallest). Rows that share a vec_id are all searched, each a positive or negative of its own; as a query counts the one with
the least label and vector, and none of them is found for it. Equal scores go by vec_id. An empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Largest component after scaling; products of 8,192 of them still have an exact sum in a double.
LARGEST = 2**20
#: Bytes of a part of a list, and queries of a block.
PART_BYTES, BLOCK = 1 << 20, 256
WINDOWS = "array<struct<w: int, lo: bigint, hi: bigint, floor: bigint>>"
LOWEST, HIGHEST = -(2**62), 2**62


@dataclass(frozen=True)
class Lists:
    """``parts``: list, part, rows packed into ids, labels and vecs. ``index``: centroids and radii, for every task."""

    parts: DataFrame
    index: Broadcast
    dim: int


def vectors(embeddings: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """The rows that take part, as (vec_id, label, vec: array<int>), written; and the number of their components."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    good = F.forall("embedding", lambda v: F.coalesce((v.cast("double") * scale >= -LARGEST) & (v.cast("double") * scale < LARGEST), F.lit(False)))
    rows = embeddings.filter("vec_id is not null and label is not null and embedding is not null").filter(good)
    rows = stored(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.cast("array<int>").alias("vec")), "vectors")
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    return rows.filter(F.size("vec") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """K-means by Lloyd's rounds from rows of the sample; centroids without rows go."""
    rng = np.random.default_rng(seed)
    c = np.unique(sample[rng.permutation(len(sample))[:count]], axis=0).astype(float)
    for _ in range(rounds):
        near = nearest(sample, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[k : k + rows] @ c.T).argmin(axis=1) for k in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


def _assign(index: Broadcast, dim: int):
    """mapInArrow: rows with their list and the distance from its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = index.value
        for batch in batches:
            x = _matrix(batch.column("vec"), dim).astype(float)
            at = nearest(x, c)
            away = np.sqrt(((x - c[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], [*batch.schema.names, "list", "away"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by (list, part): one packed row for each."""
    key, held = None, []

    def packed() -> pa.RecordBatch:
        ids, labels, vecs = (np.concatenate([h[k] for h in held]) for k in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vecs))],
            ["list", "part", "ids", "labels", "vecs"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        at, part = batch.column("list").to_numpy(), batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:], strict=False):
            if (at[a], part[a]) != key and held:
                yield packed()
                held = []
            key = (at[a], part[a])
            some = batch.slice(a, b - a)
            held.append((some.column("vec_id").to_numpy(), some.column("label").to_numpy(), some.column("vec").flatten().to_numpy()))
    if held:
        yield packed()


def build(rows: DataFrame, dim: int, list_rows: int = 2000, max_lists: int = 1024, max_sample: int = 20_000) -> Lists:
    """Inverted lists of all ``rows``: one for ``list_rows`` rows, at most ``max_lists``; k-means sees at most about
    ``max_sample`` rows (fewer of long vectors), taken by a hash of vec_id."""
    spark = rows.sparkSession
    n = rows.count()
    wanted = min(max_sample, max(1, 4_000_000 // max(dim, 1)))
    share = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(n, 1)))
    taken = lambda some, limit: _matrix(some.orderBy("vec_id", "vec").limit(limit).select("vec").toArrow().column("vec").combine_chunks(), dim).astype(float)
    sample = taken(rows.filter(share), 2 * wanted)
    if not len(sample):
        sample = taken(rows, 1)
    count = min(max_lists, max(1, n // list_rows), max(1, len(sample)))
    c = centroids(sample, count)
    of = rows.select("vec_id", "label", "vec").mapInArrow(_assign(spark.sparkContext.broadcast(c), dim), "vec_id long, label long, vec array<int>, list int, away double")
    of = stored(of, "listed")
    radii = {r["list"]: (r["r"], r["n"]) for r in of.groupBy("list").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([radii.get(k, (0.0, 0))[0] for k in range(len(c))])
    sizes = np.array([radii.get(k, (0.0, 0))[1] for k in range(len(c))], np.int64)
    # Parts by a hash of the row's place in its file, so rows of one vector do not meet in one.
    parts = np.maximum(1, -(-sizes * max(dim, 1) * 4 // PART_BYTES))
    number = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    packed = of.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number).cast("int"))
    packed = packed.repartition("list", "part").sortWithinPartitions("list", "part").select("vec_id", "label", "vec", "list", "part")
    kinds = "list int, part int, ids binary, labels binary, vecs binary"
    index = {"c": c, "norm": np.sqrt((c * c).sum(axis=1)), "radius": radius, "sizes": sizes, "parts": parts}
    return Lists(stored(packed.mapInArrow(_pack, kinds), "lists"), spark.sparkContext.broadcast(index), dim)


def _visits(index: Broadcast, dim: int, begin: int, end: int):
    """mapInArrow over queries to (list, part, block, anchor_id): a row for each part of a list to visit, of the lists at the
    places from ``begin`` to ``end`` of the query's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = index.value
        held = np.flatnonzero(i["sizes"] > 0)
        c, radius, parts = i["c"][held], i["radius"][held], i["parts"][held]
        out: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            r = np.concatenate(out or [np.zeros((0, 4), np.int64)])
            out.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(r[:, k], pa.int64()).cast(t) for k, t in enumerate(kinds)], ["list", "part", "block", "anchor_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), dim).astype(float)
            norm = np.sqrt((x * x).sum(axis=1))
            mid, wide = x @ c.T, norm[:, None] * radius
            slack = 1e-9 * norm[:, None] * (i["norm"][held] + radius) + 1e-6  # for the rounding of doubles
            upper, lower = mid + wide + slack, mid - wide - slack
            anchors, blocks = batch.column("anchor_id").to_numpy(), batch.column("block").to_numpy()
            for row, windows in enumerate(batch.column("windows").to_pylist()):
                some = np.argsort(-upper[row], kind="stable")[begin:end]
                up, low = upper[row][some], lower[row][some]
                wanted = np.zeros(len(some), bool)
                for w in windows:
                    wanted |= (up >= max(w["lo"], w["floor"])) & (low <= w["hi"])
                some = some[wanted]
                lists = np.repeat(held[some], parts[some])
                if len(lists):
                    part = np.concatenate([np.arange(p) for p in parts[some]])
                    same = np.ones(len(lists), np.int64)
                    out.append(np.stack([lists, part, same * blocks[row], same * anchors[row]], axis=1))
                if sum(map(len, out)) > 100_000:
                    yield rows()
            yield rows()

    return run


def _score(dim: int, k: int, same: bool):
    """mapInArrow over (ids, labels, vecs, queries) to the best k rows of each query's windows within each part."""

    def best(ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, queries: pa.StructArray) -> list[tuple]:
        q = queries.field("vec").flatten().to_numpy().reshape(len(queries), dim)
        scores = (q.astype(float) @ vecs.T.astype(float)).astype(np.int64) if dim <= 8192 else q.astype(np.int64) @ vecs.T.astype(np.int64)
        asked = zip(*(queries.field(c).to_pylist() for c in ("anchor_id", "label", "windows")), scores, strict=True)
        out = []
        for anchor, label, windows, s in asked:
            fits = ((labels == label) == same) & (ids != anchor)
            for w in windows:
                at = np.flatnonzero(fits & (s >= max(w["lo"], w["floor"])) & (s <= w["hi"]))
                if len(at) > k:  # all ties of the k-th score stay for the sort by vec_id
                    at = at[s[at] >= np.partition(s[at], -k)[-k]]
                at = at[np.lexsort((ids[at], -s[at]))][:k]
                out += [(anchor, w["w"], int(ids[j]), int(s[j])) for j in at]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, labels, vecs, queries in zip(*batch.columns, strict=True):
                i, of, v = (np.frombuffer(x.as_buffer(), t) for x, t in ((ids, np.int64), (labels, np.int64), (vecs, np.int32)))
                out += best(i, of, v.reshape(len(i), dim), queries.values)
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor_id", "w", "vec_id", "score"])

    return run


def in_blocks(lists: Lists, queries: DataFrame) -> DataFrame:
    """Queries (anchor_id, label, vec, windows) with a block: about ``BLOCK`` queries nearest to the same centroid, so that a
    block's queries visit the same lists."""
    centres = queries.sparkSession.sparkContext.broadcast(lists.index.value["c"])
    kinds = f"anchor_id long, label long, vec array<int>, windows {WINDOWS}, list int, away double"
    near = stored(queries.select("anchor_id", "label", "vec", "windows").mapInArrow(_assign(centres, lists.dim), kinds), "queries")
    counts = {r["list"]: r["count"] for r in near.groupBy("list").count().collect()}  # one for each list
    if not counts:
        return near.withColumn("block", F.lit(0).cast("long")).drop("list", "away")
    salt = F.element_at(F.array(*[F.lit(-(-counts.get(k, 1) // BLOCK)) for k in range(len(lists.index.value["c"]))]), F.col("list") + 1)
    return near.withColumn("block", F.col("list").cast("long") * 2**32 + F.pmod(F.xxhash64("anchor_id"), salt)).drop("list", "away")


def search(lists: Lists, queries: DataFrame, k: int, same: bool, first: int = 4) -> DataFrame:
    """The best ``k`` rows (anchor_id, w, vec_id, score, rank) of each window w of ``queries`` (anchor_id, label, vec, windows),
    of the query's label (``same``) or of another. A window takes scores from lo to hi. The first round visits ``first``
    lists of each query, every other round twice as many as the one before."""
    queries = in_blocks(lists, queries)
    count = int((lists.index.value["sizes"] > 0).sum())
    best, begin, step = None, 0, first
    order = W.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    while best is None or begin < count:
        now = queries
        if best is not None:
            # The k-th score so far is the floor of a window; a window with fewer rows has none yet.
            floors = best.groupBy("anchor_id", "w").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            floors = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floors"))
            raised = lambda w: w.withField("floor", F.coalesce(F.try_element_at("floors", w["w"]), w["floor"]))
            now = queries.join(floors, "anchor_id", "left").withColumn("windows", F.transform("windows", raised)).drop("floors")
        end = min(count, begin + step)
        visits = now.mapInArrow(_visits(lists.index, lists.dim, begin, end), "list int, part int, block long, anchor_id long")
        asked = F.collect_list(F.struct("anchor_id", "label", "vec", "windows")).alias("queries")
        # A block's queries of one part: about BLOCK at most.
        visits = stored(visits.join(now.drop("block"), "anchor_id").groupBy("list", "part", "block").agg(asked), "visits")
        pairs = visits.join(lists.parts, ["list", "part"]).select("ids", "labels", "vecs", "queries")
        with small_batches(queries.sparkSession, 16):
            found = stored(pairs.mapInArrow(_score(lists.dim, k, same), "anchor_id long, w int, vec_id long, score long"), "found")
        both = found if best is None else best.drop("rank").unionByName(found)
        best = stored(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        begin, step = end, 2 * step
    return best


def hard_negatives(
    embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    list_rows: int = 2000,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows whose vec_id is
    divisible by ``every``: of each of an anchor's ``n_positives`` best rows of its label, the ``n_negatives`` best rows of
    other labels whose score lies between ``low`` and ``high`` hundredths of the positive's. A list has about ``list_rows``."""
    rows, dim = vectors(embeddings, scale)
    lists = build(rows, dim, list_rows)
    all_ = F.array(F.struct(F.lit(0).alias("w"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"), F.lit(LOWEST).alias("floor"))).cast(WINDOWS)
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vec")).alias("row"))
    anchors = stored(anchors.select("anchor_id", "row.*"), "anchors")
    positives = search(lists, anchors.withColumn("windows", all_), n_positives, True)
    positives = stored(positives.select("anchor_id", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # The least and the largest whole score of the window.
    bound = lambda share, more: F.expr(f"(positive_score * {share} + {more} - pmod(positive_score * {share} + {more}, 100)) div 100")
    window = F.struct("w", bound(low, 99).alias("lo"), bound(high, 0).alias("hi"), F.lit(LOWEST).alias("floor"))
    windows = positives.groupBy("anchor_id").agg(F.collect_list(window).cast(WINDOWS).alias("windows"))
    found = search(lists, anchors.join(windows, "anchor_id"), n_negatives, False)
    return found.join(positives, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
