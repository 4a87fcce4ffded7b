"""Near copies by exact Jaccard similarity of word shingles, for the corpus pipeline.

Candidates share a band: ``ROWS`` of the least hashes of their shingles, for one of ``BANDS`` independent groups. Of two
texts at similarity 0.8 all bands differ with a chance of (1 - 0.8 ** 5) ** 24, 7 in 100,000; more alike ones less. A
candidate counts only once its similarity, of whole shingle sets, is known. Pairs are spared this where it cannot reach
the limit: by their numbers of shingles, or because of 120 least hashes fewer than 6 in 10 agree (at similarity 0.8 that
has a chance of 1 in 10 million). Shingle sets are made for the rows of the other pairs only, by a second reading.

First SimHash, as operator 8 has it but over five-word shingles: fingerprints of 64 bits, met through deletion variants at up
to ``MAX_BITS`` different bits. Its links count once their similarity is known too. At similarity 0.8 about 10 bits differ, so
the bands find what it cannot; members that SimHash has linked are one component from the start.

1. A bucket's members are compared with its least one.
2. A bucket of three or more members that are not one component then is searched in memory, from component to component
   over those not yet reached, which gives spanning links rather than all pairs. Buckets with the same members are one.
3. Crowded buckets are keyed again: a member goes to a bucket for each later band together with the first, and, where that
   is crowded too, for each still later one with those two; steps 1 and 2 follow each time. Two texts at similarity 0.8
   that meet in a crowded bucket share a second band but in 9 of 10,000 cases, and three bands but in 55.
4. Buckets of three bands that are crowded still are dealt into blocks by a hash. Each block is searched, then each pair of
   blocks, so every pair of members meets in some task and no task holds more than two blocks.

Defined results: null text is empty; fewer words than a shingle make one shingle of all; rows of one text, null or empty ones
too, are near copies of each other; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, small_batches, stored
from .simhash import keep_one, mix64, with_rows
from .simhash import links as simhash_links

BANDS, ROWS = 24, 5
#: Bits in which linked fingerprints may differ.
MAX_BITS = 4
#: Odd factors and offsets of the least hashes.
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Least hashes that must agree before a pair's whole sets are compared.
AGREE = BANDS * ROWS * 6 // 10
PAIR = "a long, b long"


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted different hashes of a text's word shingles, rolled from the words' XXH64."""
    words = text.lower().split()  # of bytes: A-Z and ASCII spaces only
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    g = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        g = g * ODD + h[k : k + n]
    return np.unique(mix64(g))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    held = np.empty((min(len(hashes), 128), BANDS * ROWS), np.uint64)
    for k in range(0, len(hashes), 128):
        some = hashes[k : k + 128, None]
        out = held[: len(some)]
        np.multiply(some, FACTORS, out=out)
        np.add(out, OFFSETS, out=out)
        np.minimum(least, out.min(axis=0), out=least)
    return mix64(least)


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each band of least hashes."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix64(key ^ column)
    return key


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: bit i is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 200_000):
        ones += np.unpackbits(hashes[k : k + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _prints(shingle: int):
    """mapInArrow: (row, text) to (row, n, print, bands, fp): the shingles' number, a byte of each least hash, the band keys,
    the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_bytes(t.as_py()), shingle) for t in batch.column(1)]
            if not sets:
                continue
            least = [least_hashes(s) for s in sets]
            keys = np.concatenate([bands(x) for x in least]).view(np.int64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            n = np.array([len(s) for s in sets], np.int32)
            fp = pa.array([fingerprint(s) for s in sets], pa.int64())
            marks = pa.array([(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in least], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), marks, pa.ListArray.from_arrays(ends, pa.array(keys)), fp], ["row", "n", "print", "bands", "fp"])

    return run


def _sets(shingle: int):
    """mapInArrow: (row, text) to (row, hashes): the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_bytes(t.as_py()), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "hashes"])

    return run


def _promising():
    """mapInArrow: (a, b, print_a, print_b) to the pairs (a, b) of which enough least hashes agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE, pa.bool_()))

    return run


def _alike(least: float):
    """mapInArrow: (a, b, hashes_a, hashes_b) to the pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def spanning(rows: list[int], labels: list[int], prints: list[bytes], sets: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links that span what the members of a bucket add to the components (labels) that they are in already."""
    seen = np.frombuffer(b"".join(prints), np.uint8).reshape(len(rows), -1)
    hashes = [np.frombuffer(s, np.uint64) for s in sets]
    label = np.array(labels)
    out: list[tuple[int, int]] = []
    rest = np.ones(len(rows), bool)
    while rest.any():
        todo = np.flatnonzero(label == label[rest.argmax()]).tolist()
        rest[todo] = False
        while todo and rest.any():
            one = todo.pop()
            near = np.flatnonzero(rest)
            near = near[(seen[near] == seen[one]).sum(axis=1) >= AGREE]
            for k in near.tolist():
                if rest[k] and alike(hashes[one], hashes[k], least):
                    out.append((rows[one], rows[k]))
                    found = np.flatnonzero(label == label[k])
                    rest[found] = False
                    todo += found.tolist()
    return out


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Of rows sorted by the first column, the other columns of each run of one value."""
    key, members = None, []
    for batch in batches:
        for k, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if members:
                    yield list(map(list, zip(*members, strict=True)))
                key, members = k, []
            members.append(member)
    if members:
        yield list(map(list, zip(*members, strict=True)))


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows (key, key, row, label, print) sorted by key: (key, row, label) of the members of which enough
    least hashes agree with those of a member of another label."""
    for key, row, label, prints in _by_key(batches):
        seen = np.frombuffer(b"".join(prints), np.uint8).reshape(len(row), -1)
        of = np.array(label)
        keep = np.array([((of != of[k]) & ((seen == seen[k]).sum(axis=1) >= AGREE)).any() for k in range(len(row))])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[keep]) for c in (key, row, label)], ["key", "row", "label"])


def _span(least: float):
    """mapInArrow over rows (key, row, label, print, hashes) sorted by key: each bucket's spanning links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [link for members in _by_key(batches) for link in spanning(*members, least)]
        two = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["a", "b"])

    return run


def picked(rows: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` whose row is in ``ids`` (each once): up to ``most`` ids go to every task, more are met by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "row", "left_semi")


def links(rows: DataFrame, shingle: int = 5, least: float = 0.8, crowded: int = 2048, hashes: int = 2_000_000, levels: int = 3) -> DataFrame:
    """Links (a, b) that span the graph of rows (row, text) of a Jaccard similarity of at least ``least``.

    A bucket of more than ``crowded`` members or ``hashes`` shingles in all is keyed by another band, up to ``levels``, and
    then dealt into blocks of about half that. Without levels only SimHash finds candidates.
    """
    spark = rows.sparkSession
    texts = rows.select("row", "text")
    with small_batches(spark, 2000):
        prints = stored(texts.mapInArrow(_prints(shingle), "row long, n int, print binary, bands array<long>, fp long"), "prints")
    marks = prints.select("row", "print")

    def with_sets(pairs: DataFrame, *ends: str) -> DataFrame:
        """``pairs`` with the shingle sets of the rows in the columns ``ends``."""
        ids = pairs.select(F.explode(F.array(*ends)).alias("row")).distinct()
        with small_batches(spark):
            sets = stored(picked(texts, stored(ids, "picked")).mapInArrow(_sets(shingle), "row long, hashes binary"), "sets")
        for end in ends:
            pairs = pairs.join(sets.select(F.col("row").alias(end), F.col("hashes").alias("hashes" if end == "row" else f"hashes_{end}")), end)
        return pairs

    def checked(pairs: DataFrame) -> DataFrame:
        """Of different pairs (a, b) those that are similar enough."""
        named = lambda end: marks.select(F.col("row").alias(end), F.col("print").alias(f"print_{end}"))
        some = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "print_a", "print_b")
        some = stored(some.mapInArrow(_promising(), PAIR), "promising")
        both = with_sets(some, "a", "b").select("a", "b", "hashes_a", "hashes_b")
        with small_batches(spark):
            return stored(both.mapInArrow(_alike(least), PAIR), "alike")

    def searched(of: DataFrame) -> DataFrame:
        """Spanning links within each group (key) of members (key, row, label)."""
        of = of.join(marks, "row").repartition("key").sortWithinPartitions("key").select("key", F.col("key").alias("k"), "row", "label", "print")
        with small_batches(spark, 2000):
            some = stored(of.mapInArrow(_hopeful, "key long, row long, label long"), "hopeful")
        whole = with_sets(some, "row").join(marks, "row").select("key", "row", "label", "print", "hashes")
        with small_batches(spark):
            return stored(whole.repartition("key").sortWithinPartitions("key").mapInArrow(_span(least), PAIR), "spanning")

    def buckets_of(members: DataFrame) -> DataFrame:
        """Members (key, band, row, n) of the buckets of several, with their number m and the least member c (c_n shingles)."""
        of = members.groupBy("key").agg(F.min(F.struct("row", "n")).alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        of = stored(of.select("key", "m", F.col("c.row").alias("c"), F.col("c.n").alias("c_n")), "centres")
        return stored(members.join(of, "key"), "buckets")

    def open_buckets(members: DataFrame) -> DataFrame:
        """Members (key, band, row, n) of the buckets of more than one component, with its label and the number of blocks."""
        parts = stored(connected_components(found), "parts")
        labels = members.join(parts.withColumnRenamed("node", "row"), "row", "left").select("key", "band", "row", "n", F.coalesce("component", "row").alias("label"))
        labels = stored(labels, "labels")
        split = labels.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"),
            F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.max("band").alias("band"),
        ).filter("lo < hi")
        blocks = F.when((F.col("m") > crowded) | (F.col("all") > hashes), F.greatest(F.ceil(2 * F.col("m") / crowded), F.ceil(2 * F.col("all") / hashes), F.lit(2))).otherwise(1)
        split = split.withColumn("blocks", blocks.cast("int"))
        # Small buckets with the same members are one; crowded ones have other bands to go on with.
        same = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.lit(0))
        one = split.groupBy("m", "x", "y", same.alias("same")).agg(F.min(F.struct("key", "blocks")).alias("one"))
        return stored(labels.join(stored(one.select("one.*"), "split"), "key"), "open")

    def by_fingerprint() -> DataFrame:
        """Links of fingerprints between the least rows that have them, and of each row with the least of its fingerprint,
        that are similar enough."""
        first = stored(prints.groupBy("fp").agg(F.min("row").alias("first")), "fingerprints")
        equal = prints.join(first, "fp").filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
        named = lambda end: first.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(end))
        linked = simhash_links(first.select("fp"), MAX_BITS).distinct().toDF("fp_a", "fp_b").join(named("a"), "fp_a").join(named("b"), "fp_b")
        return checked(stored(equal.unionByName(linked.select("a", "b")), "simhash"))

    near = F.least("n", "c_n") >= least * F.greatest("n", "c_n")
    members = prints.select("row", "n", F.posexplode("bands").alias("band", "key"))
    found = by_fingerprint()
    if not levels:
        return found
    for level in range(levels):
        buckets = buckets_of(members.select("key", "band", "row", "n"))
        pairs = checked(buckets.filter((F.col("row") != F.col("c")) & near).select(F.col("c").alias("a"), F.col("row").alias("b")).distinct())
        found = stored(found.unionByName(pairs), "found")
        rest = open_buckets(buckets.filter("m > 2").select("key", "band", "row", "n"))
        more = searched(rest.filter("blocks = 1").select("key", "row", "label"))
        found = stored(found.unionByName(more), "found")
        rest = rest.filter("blocks > 1")
        if rest.isEmpty():
            return found
        if level < levels - 1:
            later = rest.join(prints.select("row", "bands"), "row").select("row", "n", "key", F.col("band").alias("last"), F.posexplode("bands").alias("band", "other"))
            members = later.filter("band > last").withColumn("key", F.xxhash64("key", "other"))
    rest = open_buckets(rest.select("key", "band", "row", "n")).withColumn("block", F.pmod(F.xxhash64("key", "row"), "blocks").cast("int"))
    own = searched(rest.select(F.xxhash64("key", "block").alias("key"), "row", "label"))
    found = stored(found.unionByName(own), "found")
    rest = open_buckets(rest.select("key", "band", "row", "n")).filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("key", "row"), "blocks").cast("int"))
    # A row comes once for each other block of its bucket.
    pairs = rest.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))))
    pairs = pairs.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return found.unionByName(searched(pairs.select("key", "row", "label")))


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies stays, with its columns: that of the smallest doc_id, nulls last.

    Rows are told apart by themselves, so a null or shared doc_id joins no groups.
    """
    rows, name = with_rows(docs)
    plain = rows.select(F.col(name).alias("row"), "text")
    return keep_one(rows, name, connected_components(links(plain, shingle, least))).select(*[F.col(f"`{c}`") for c in docs.columns])
