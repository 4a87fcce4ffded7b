"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments, so of two fingerprints at most ``max_bits`` apart one
segment differs by at most one bit. Every segment is indexed once for each of its bits with that bit left out; two
segments at most one bit apart share such a key. An equality join on the keys meets every link, and the whole
fingerprints are then verified.

Equal fingerprints are one entry from the start, so copies never meet in pairs. A bucket is searched from entry to
entry over those not yet reached, and gives a spanning set of its links rather than all pairs. Buckets of more than
``split_over`` entries are keyed a second time on their other bits first.

Defined results: null text is empty; a text without words has fingerprint 0; fewer words than a shingle make one shingle
of all; rows that share a doc_id are one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, stored

BITS = 64


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()  # of bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 200_000):
        ones += np.unpackbits(h[k : k + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        out = [fingerprint(b"" if t is None else t.encode("utf-8", "surrogatepass"), shingle) for t in texts]
        return pd.Series(np.array(out, np.uint64).view(np.int64), dtype="int64")

    return fingerprints


def segments(bits: list[int], count: int) -> list[list[int]]:
    """``bits`` in ``count`` runs of nearly equal length."""
    edges = [len(bits) * k // count for k in range(count + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def variants(max_bits: int, bits: list[int] | None = None) -> list[tuple[int, int]]:
    """(tag, mask): the bits that a key keeps, one for each bit left out of a segment."""
    out = []
    for seg in segments(list(range(BITS)) if bits is None else bits, max_bits // 2 + 1):
        for left_out in seg:
            out.append((len(out), sum(1 << b for b in seg if b != left_out)))
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_links(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning set of the links among different fingerprints: each is reached once, from one it links to."""
    rest = members
    links = []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count(rest ^ one) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                todo.extend(found)
                links += [(int(one), int(x)) for x in found]
    return links


def _index(max_bits: int):
    """mapInArrow: fingerprints to (key, fp), one row for each variant."""
    keys = variants(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy().view(np.uint64)
                key = np.concatenate([mix64((fp & np.uint64(mask)) ^ mix64(np.array([tag + 1], np.uint64))) for tag, mask in keys])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.tile(fp, len(keys)).view(np.int64))], ["key", "fp"]
                )

    return run


def _again(max_bits: int):
    """mapInArrow: rows of crowded buckets to (key, fp) with a second key on bits outside the first key's segment."""
    first = variants(max_bits)
    segs = segments(list(range(BITS)), max_bits // 2 + 1)
    second = [variants(max_bits, [b for b in range(BITS) if b not in seg]) for seg in segs]
    of = np.repeat(np.arange(len(segs)), [len(s) for s in segs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                old = batch.column(0).slice(at, 2000).to_numpy().view(np.uint64)
                fp = batch.column(1).slice(at, 2000).to_numpy().view(np.uint64)
                for tag, (_, mask) in enumerate(first):
                    mine = mix64((fp & np.uint64(mask)) ^ mix64(np.array([tag + 1], np.uint64))) == old
                    if not mine.any():
                        continue
                    f, o = fp[mine], old[mine]
                    more = second[of[tag]]
                    key = np.concatenate([mix64(o ^ mix64((f & np.uint64(m)) ^ mix64(np.array([t + 1001], np.uint64)))) for t, m in more])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.tile(f, len(more)).view(np.int64))], ["key", "fp"]
                    )

    return run


def _search(max_bits: int, split_over: int | None):
    """mapInArrow over rows sorted by key: the spanning links (a, b) of each bucket, or a crowded one's (key, fp)."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(key)) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(key)]]))
        starts = np.concatenate([[0], edges])
        out, crowded = [], np.zeros((0, 2), np.int64)
        if split_over is not None and (big := sizes > split_over).any():
            at = np.repeat(big, sizes)
            crowded = np.stack([key[at], fp[at].view(np.int64)], axis=1)
            starts, sizes = starts[~big], sizes[~big]
        pairs = starts[sizes == 2]  # most buckets have two entries: all at once
        if len(pairs):
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits]
            out += zip(fp[near].tolist(), fp[near + 1].tolist(), strict=True)
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out += bucket_links(fp[a : a + n], max_bits)
        two = np.concatenate([np.array(out, np.uint64).reshape(-1, 2).view(np.int64), crowded])
        kind = np.arange(len(two)) >= len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(kind)], ["a", "b", "crowded"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
            if whole:
                yield links(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield links(key, fp)

    return run


def links(fingerprints: DataFrame, max_bits: int = 4, split_over: int = 2000) -> DataFrame:
    """Links (a, b) that span the graph of different fingerprints (column fp) at most ``max_bits`` apart."""

    def search(rows: DataFrame, limit: int | None) -> DataFrame:
        rows = rows.repartition("key").sortWithinPartitions("key")
        return stored(rows.mapInArrow(_search(max_bits, limit), "a long, b long, crowded boolean"), "links")

    found = search(fingerprints.mapInArrow(_index(max_bits), "key long, fp long"), split_over)
    crowded = found.filter("crowded").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    found = found.filter("not crowded").select("a", "b")
    if crowded.isEmpty():
        return found
    again = search(crowded.repartition("key", "fp").mapInArrow(_again(max_bits), "key long, fp long"), None)
    return found.unionByName(again.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, split_over: int = 2000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_print = links(classes.select("fp"), max_bits, split_over).distinct()
    # Rows that share a doc_id hold their fingerprints together, as if linked.
    ids = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id", "a")
    same_id = prints.join(ids, "doc_id").select("a", F.col("fp").alias("b"))
    groups = connected_components(by_print.unionByName(same_id))
    members = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        classes["fp"], "least", F.coalesce("component", "fp").alias("component")
    )
    # Written before they are joined, so that a common component or fingerprint is split where the join meets two shuffles.
    members = stored(members, "members")
    least = stored(members.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = stored(members.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each row, and that column's name."""
    (name,) = fresh(docs, "row_id")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def keep_one(rows: DataFrame, name: str, groups: DataFrame) -> DataFrame:
    """``rows`` with one row of each component of ``groups`` (node, component: values of column ``name``); rows that no
    group names stay. The smallest doc_id stays (nulls last), of several the first by text digest and row."""
    ids = rows.select(F.col(name).alias("node"), F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("digest"))
    best = ids.join(groups, "node").groupBy("component").agg(F.min(F.struct("none", "doc_id", "digest", "node")).alias("best"))
    gone = groups.join(best.select(F.col("best.node").alias("node")), "node", "left_anti").select(F.col("node").alias(name))
    return rows.join(gone, name, "left_anti")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, split_over: int = 2000) -> DataFrame:
    """One row of each component stays, with its columns: that of the smallest doc_id, nulls last.

    Components are of fingerprints alone: rows are told apart by themselves, so a null or shared doc_id joins none.
    """
    rows, name = with_rows(docs)
    prints = stored(rows.select(F.col(name).alias("node"), fingerprint_udf(shingle)("text").alias("fp")), "prints")
    by_print = stored(connected_components(links(prints.select("fp").distinct(), max_bits, split_over).distinct()), "components")
    groups = prints.join(by_print.select(F.col("node").alias("fp"), "component"), "fp", "left")
    groups = stored(groups.select("node", F.coalesce("component", "fp").alias("component")), "groups")
    return keep_one(rows, name, groups).select(*[F.col(f"`{c}`") for c in docs.columns])
