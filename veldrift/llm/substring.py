"""Substring dedup: words under windows that occur more than once, by prefix-partitioned suffix groups.

A window is ``WINDOW`` consecutive words. Suffixes are sampled where equal windows must sample alike: at the window's
anchor, its least ``PREFIX``-word sequence by hash (the leftmost of equals). The suffixes are split by prefixes of
variable length:

1. ``PREFIX`` words from the anchor. A prefix that occurs once is a leaf above the depth of a window and ends there.
2. The whole run: all windows that share an anchor, with their words on both sides. A run that occurs again is a deep
   internal node, and all its windows are repeats, whatever the number of its places; places are only counted.
3. What is left, runs that differ but share a prefix, is split again by the words around the anchor until a group fits
   in memory; the sorted suffixes of a group, compared with their neighbours to the depth of a window, give its repeats.
   The last prefix is the window itself, where nothing is left to compare.

Documents are known by doc_id and text digest; rows alike in both are places of their own that share the result.

Defined results: null text is empty; a text of fewer words than a window loses none; null doc_id is a document like any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rows_with, scratch_path, stored

WINDOW = 35
PREFIX = 8
#: Runs in a group that are compared in memory; a larger group takes the longest prefix.
GROUP = 2000
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_BACK = np.uint64(pow(int(ODD), -1, 1 << 64))
PLACES = np.uint64((1 << 22) - 1)
BLOCK = 1 << 21


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of word hashes: anchors, the first and last of their windows, and the hashes of prefix and run."""
    n = len(h) - window + 1
    g = np.zeros(len(h) - prefix + 1, np.uint64)
    for k in range(prefix):
        g = g * ODD + h[k : k + len(g)]
    g = _mixed(g)
    # Hash above, place below: the least is the leftmost of equals.
    low, width, span = (g & ~PLACES) | np.arange(len(g), dtype=np.uint64), 1, window - prefix + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    at = (np.minimum(low[:n], low[span - width : span - width + n]) & PLACES).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    a = at[first]
    # Words first .. last + window - 1, as a polynomial that does not depend on the place, and where the anchor is.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h) * np.cumprod(np.full(len(h), ODD)))])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, ODD_BACK)]))
    run = (total[last + window] - total[first]) * back[first]
    run = _mixed(run ^ _mixed((last - first).astype(np.uint64) * ODD + (a - first).astype(np.uint64)))
    return a, first, last, g[a], run


def all_anchors(h: np.ndarray, window: int, prefix: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of a document, in blocks of windows if it is very long."""
    n = len(h) - window + 1
    for s in range(0, n, BLOCK):
        a, first, last, key, run = anchors(h[s : min(s + BLOCK, n) + window - 1], window, prefix)
        yield a + s, first + s, last + s, key, run


def _anchor_rows(window: int, prefix: int):
    """mapInArrow: (doc, sha, text) to a row for each anchor; ``place`` holds it and its first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[tuple[np.ndarray, ...]] = []
            rows = 0
            for doc, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                for a, first, last, key, whole in all_anchors(word_hashes(words), window, prefix):
                    place = a << 16 | (a - first) << 8 | (last - first)
                    cols.append((np.full(len(a), doc), np.full(len(a), sha), place, key.view(np.int64), whole.view(np.int64)))
                    rows += len(a)
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], ROW)
                    cols, rows = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], ROW)

    return run


ROW = ["doc", "sha", "place", "prefix", "run"]
ANCHOR = "shiftright(place, 16)"
FIRST = f"({ANCHOR} - (shiftright(place, 8) & 255))"
LAST = f"({FIRST} + (place & 255))"


def _cut(window: int):
    """mapInArrow: documents with the runs asked of them to (prefix, more, doc, sha, first, at, words).

    A crowded prefix is made longer instead: a row for each window, with the hash of all its words, and no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, sha, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                for r in runs.as_py():
                    if r["crowded"]:
                        for i in range(r["first"], r["last"] + 1):
                            h = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + window]))
                            out.append(((h >> 64) - (1 << 63), (h & ALL) - (1 << 63), doc, sha, i, 0, None))
                        size += 64 * (r["last"] - r["first"] + 1)
                    else:
                        part = b" ".join(words[r["first"] : r["last"] + window])
                        out.append((r["prefix"], None, doc, sha, r["first"], r["anchor"] - r["first"], part))
                        size += len(part)
                    if size > 2_000_000:
                        yield _batch(out, CUT)
                        out, size = [], 0
            if out:
                yield _batch(out, CUT)

    return run


ALL = (1 << 64) - 1
CUT = pa.schema([("prefix", pa.int64()), ("more", pa.int64()), ("doc", pa.int64()), ("sha", pa.int64()), ("first", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])
FOUND = pa.schema([("doc", pa.int64()), ("sha", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeats(runs: list[tuple], window: int) -> list[tuple]:
    """Windows that occur in more than one place of a group: (doc, sha, first, last).

    A run is (doc, sha, first, at, words). The group's suffixes are sorted; two neighbours that agree to the depth of a
    window lie below one deep internal node. Equal windows begin equally far before their anchors, so suffixes are
    sorted apart by that distance.
    """
    suffixes: dict[int, list[tuple[bytes, int, int]]] = {}
    for k, (_, _, _, at, text) in enumerate(runs):
        ends = [-1, *(i for i, c in enumerate(text) if c == 32), len(text)]
        for i in range(len(ends) - window):
            suffixes.setdefault(at - i, []).append((text[ends[i] + 1 : ends[i + window]], k, i))
    found: list[tuple[int, int]] = []
    for group in suffixes.values():
        group.sort()
        for x, y in zip(group, group[1:], strict=False):
            if x[0] == y[0]:
                found += (x[1:], y[1:])
    out: list[list[int]] = []
    for k, i in sorted(set(found)):
        doc, sha, first, _, _ = runs[k]
        if out and out[-1][:2] == [doc, sha] and out[-1][3] == first + i - 1:
            out[-1][3] += 1
        else:
            out.append([doc, sha, first + i, first + i])
    return [tuple(x) for x in out]


def _compare(window: int):
    """mapInArrow over rows sorted by group: the windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    if len(rows) > 1:
                        out += repeats(rows, window)
                    key, rows = g, []
                rows.append(tuple(row))
            if len(out) > 50_000:
                yield _batch(out, FOUND)
                out = []
        if len(rows) > 1:
            out += repeats(rows, window)
        yield _batch(out, FOUND)

    return run


def _strip(window: int):
    """mapInArrow: documents with their repeated windows to counts and the digest of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                runs = runs.as_py()
                gone = 0
                if runs:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, [r["first"] for r in runs], 1)
                    np.add.at(step, [r["last"] + window for r in runs], -1)
                    stay = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    kept = words
                out.append((doc, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept)))
            yield _batch(out, OUT)

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_words", pa.binary())])


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Runs of windows that also start elsewhere: (doc, sha, first, last), from rows of (doc, sha, text)."""
    if not prefix <= window <= 255:
        raise ValueError("a window has 8 bits in a place, and holds a prefix")
    spark = docs.sparkSession
    paths = [scratch_path(spark, name) for name in ("anchors", "often", "asked")]
    kinds = "doc long, sha long, place long, prefix long, run long"
    rows = stored(docs.mapInArrow(_anchor_rows(window, prefix), kinds), "", paths[0])
    often = stored(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "", paths[1])
    rows = stored(rows_with(rows, often, ["prefix"]), "shared")
    discard(spark, *paths[:2])
    runs = stored(
        rows.groupBy("prefix", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sha", "place")).alias("one")), "runs"
    )
    again = rows_with(rows, runs.filter("n > 1"), ["prefix", "run"])
    again = again.select("doc", "sha", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"))
    # Prefixes with a run that occurs once, and others to compare it with.
    open_ = runs.groupBy("prefix").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).filter("runs > 1 and least = 1")
    asked = (
        runs.select("prefix", "one.*").join(open_.select("prefix", (F.col("runs") > group).alias("crowded")), "prefix")
        .select("doc", "sha", F.struct("prefix", F.expr(ANCHOR).alias("anchor"), F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"), "crowded").alias("r"))
        .groupBy("doc", "sha").agg(F.collect_list("r").alias("asked"))
    )
    asked = stored(asked, "", paths[2])
    cuts = docs.join(asked, ["doc", "sha"]).select("doc", "sha", "text", "asked")
    cuts = stored(cuts.mapInArrow(_cut(window), "prefix long, more long, doc long, sha long, first long, at long, words binary"), "cuts")
    discard(spark, paths[2])
    small = cuts.filter("words is not null").select("prefix", "doc", "sha", "first", "at", "words")
    small = small.repartition("prefix").sortWithinPartitions("prefix")
    found = small.mapInArrow(_compare(window), "doc long, sha long, first long, last long")
    large = cuts.filter("words is null").select("prefix", "more", "doc", "sha", "first")
    twice = large.groupBy("prefix", "more").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    long_ = rows_with(large, stored(twice, "twice"), ["prefix", "more"]).select("doc", "sha", "first", F.col("first").alias("last"))
    return again.unionByName(found).unionByName(long_)


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_words (joined by one space)."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("sha"), "text")
    found = repeated_windows(texts.select("doc", "sha", "text"), window, prefix, group)
    found = stored(found.groupBy("doc", "sha").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "gone")
    discard(spark)
    out = texts.join(found, ["doc", "sha"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_words binary")
