"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Tokenising and placing run as Spark jobs over pieces. The packing itself needs only how many pieces there are of each
length, at most ``capacity`` numbers whatever the input, so it is solved for all pieces at once:

1. Reduction, from the longest length down: a bin's set is fixed for good where it provably dominates every other set
   that could go with that length (the best single piece alone, a perfect pair, or the one best pair).
2. Best fit of what remains, longest first, many equal bins at a time.

The result is a table of steps (length, ranks, bins, offset); a piece finds its step by its rank among the pieces of its
length. Ranks are counted in salted groups, so no task holds all pieces of one length.

Defined results: null text is empty and packs as its end token; rows that repeat are packed one by one; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 4096
END_ID = 1
SALTS = 64
#: Texts of these characters only are cut into the tokenizer's pieces here; others go to the tokenizer whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f]*")
#: Fixed value: the tokenizer's own pieces of a lower-cased text, for the characters of ``PLAIN``.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u017f]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-\u017f0-9²³¹¼½¾]+")
#: The normaliser and splitting of the tokenizer that ``PIECE`` stands for; a file with others gets whole texts.
NORMALIZER = {
    "type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces in a task's table, after which it starts anew. The table goes with its task.
PIECES = 400_000


def byte_letters() -> dict[int, str]:
    """Latin-1 characters to the byte-level model's letters: printable ones stay, the others follow from 256 on."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


class PieceTable(dict):
    """A piece of text to the bytes of its ids; the model turns pieces into ids one by one, so a text is its pieces' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.known = (
            spec.get("normalizer") == NORMALIZER and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT}
            and not spec.get("post_processor") and all("<|" in t for t in added)
        )

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        self[piece] = data = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        return data

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        if not self.known or "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, PIECE.findall(text.lower())))


def _pieces(path: str, capacity: int, end_id: int):
    """mapInArrow: (doc_id, text) to pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = table.encode(text.as_py() or "") + end
                n = len(data) // 4
                for k in range(-(-n // capacity)):
                    part = data[4 * k * capacity : 4 * (k + 1) * capacity]
                    out.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, KINDS, strict=True)], NAMES
            )

    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def reduce_counts(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Dominance reduction, in place, of ``left`` (pieces by length): the sets that are fixed, each with its number.

    For the longest length a with room r beside it, a set {a, ...} is fixed if it dominates all others with a:
    nothing else fits; or the longest b that fits fills the room, or no two others fit together, or no two that fit
    together sum to more than b; or at most two fit and the pair of b with the longest c that fits beside it is at least
    as long, part by part, as any other pair. Otherwise a waits for best fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for a in range(capacity, 0, -1):
        while left[a]:
            r = capacity - a
            left[a] -= 1
            have = np.flatnonzero(left[: r + 1])
            left[a] += 1
            if not len(have):
                n = int(left[a]) if a > r else 1
                left[a] -= n
                fixed.append(((a,), n))
                continue
            b = int(have[-1])
            extra = lambda x: left[x] - (x == a)  # noqa: B023, E731  pieces of length x beside one of a
            small = int(have[0])
            second = small if extra(small) > 1 else int(have[1]) if len(have) > 1 else None
            if b == r or second is None or small + second > r:
                n = int(left[a] // 2) if a == b else int(min(left[a], left[b]))
                left[a] -= n
                left[b] -= n
                fixed.append(((a, b), n))
                continue
            lows = [int(y) for y in have[:3] for _ in range(min(int(extra(y)), 3))][:3]
            if len(lows) == 3 and sum(lows) <= r:
                break
            x = have[2 * have <= r]  # the shorter of a pair; y: the longest that fits beside it
            k = np.searchsorted(have, r - x, side="right") - 1
            k -= (have[k] == x) & (extra(x) < 2)
            x, y = x[k >= 0], have[k[k >= 0]]
            best_sum, best_low = (int((x + y).max()), int(np.minimum(x, y).max())) if len(x) else (0, 0)
            if best_sum <= b:
                n = int(left[a] // 2) if a == b else int(min(left[a], left[b]))
                left[a] -= n
                left[b] -= n
                fixed.append(((a, b), n))
                continue
            beside = [int(x) for x in have if x <= r - b and (x != b or extra(b) > 1)]
            c = beside[-1] if beside else 0
            if c and best_low <= c and a not in (b, c) and b != c:
                n = int(min(left[a], left[b], left[c]))
                for x in (a, b, c):
                    left[x] -= n
                fixed.append(((a, b, c), n))
                continue
            break
    return fixed


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Steps (length, rank, last, per_bin, first_bin, offset): pieces of a length with rank <= their rank < last go
    ``per_bin`` to a bin from ``first_bin`` on, the first of a bin at ``offset``."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    steps: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(length: int, per_bin: int, first: int, n_bins: int, offset: int) -> None:
        n = per_bin * n_bins
        steps.append((length, int(used[length]), int(used[length]) + n, per_bin, first, offset))
        used[length] += n

    rooms: dict[int, list[tuple[int, int]]] = {}  # room left in a bin: runs of such bins (first, number)
    order: list[int] = []

    def opened(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first, n))

    for lengths, n in reduce_counts(left, capacity):
        at = 0
        for x in lengths:
            put(x, 1, bins, n, at)
            at += x
        opened(capacity - at, bins, n)
        bins += n
    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            k = bisect.bisect_left(order, x)
            if k == len(order):
                q = min(capacity // x, n)
                first, m, room = bins, n // q, capacity
                bins += m
            else:
                room = order[k]
                first, m = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
                q = min(room // x, n)
                take = min(m, n // q)
                opened(room, first + take, m - take)
                m = take
            put(x, q, first, m, capacity - room)
            opened(room - q * x, first, m)
            n -= q * m
    names = ["length", "rank", "last", "per_bin", "first_bin", "offset"]
    return pd.DataFrame(steps, columns=names, dtype="int64")


def _place(steps: pd.DataFrame, capacity: int):
    """mapInArrow: pieces with their rank to their sequence and place in it."""
    steps = steps.sort_values(["length", "rank"])
    length, rank = steps["length"].to_numpy(), steps["rank"].to_numpy()
    rest = steps[["per_bin", "first_bin", "offset"]].to_numpy()
    start = np.searchsorted(length, np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(n), np.int64)
            for x in np.unique(n):
                of = n == x
                at[of] = start[x] + np.searchsorted(rank[start[x] : start[x + 1]], r[of], side="right") - 1
            past, (q, first, offset) = r - rank[at], rest[at].T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first + past // q), pa.array(offset + past % q * n)],
                [*NAMES, "sequence_id", "offset"],
            )

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path``: the tokenizer's file, which every executor can open.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id), kinds)
    pieces = stored(pieces, "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    cells = pieces.groupBy("length", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = stored(cells.withColumn("at", F.coalesce(F.sum("n").over(upto), F.lit(0))), "cells")
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in cells.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[x] = n
    steps = plan(counts, capacity)
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (
        pieces.withColumn("salt", salt).withColumn("place", place)
        .join(F.broadcast(cells.select("length", "salt", "at")), ["length", "salt"])  # at most capacity * SALTS rows
        .select(*NAMES, (F.col("at") + F.col("place")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(_place(steps, capacity), f"{kinds}, sequence_id long, offset long")
