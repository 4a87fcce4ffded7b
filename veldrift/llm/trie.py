"""A prefix trie of conversations: every distinct sequence of first turns is a node.

1. Turns get their places in a sort by ranges, numbered by a numpy scan; a conversation that crosses ranges gets the count
   of the ranges before, so no task needs a whole conversation.
2. Every prefix of a sequence gets a polynomial rolling fingerprint, modulo two primes, by a numpy scan over chunks of
   ``size`` turns; the chunks before add one number each.
3. Prefixes of the same depth and fingerprint are a candidate group. Each member's last turn is compared, as text, with that
   of the group's representative (the smallest conv_id), and the fingerprints before it too; as every depth is compared so,
   equal groups are equal sequences, turn by turn. Members that differ get a number of their own at that turn, which
   enters the fingerprints of all longer prefixes, and the groups are verified again.
4. Parent rollup. The representative of a node represents all deeper nodes of its own sequence too, so a node's figures ride
   on its representative's conversation and are added to every prefix of it: one aggregation sums the subtrees of all
   depths, instead of a round for each depth.

Defined results: null role or text is empty; rows without conv_id take no part; turns of the same number are ordered by
role, then text; equal rows are turns of their own; an empty table has no nodes. Texts are moved once for the order and are
read again only where two different turns have to be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored

CHUNK = 4096
#: Primes below 2 ** 31 and a base for each.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525013))
#: What a number of its own is summed by; never masked.
SPLITS = (2147483587, 1597334677)
KEY = ["depth", "fp", "own"]


@dataclass(frozen=True)
class Trie:
    """``nodes``: conv_id (smallest member) and depth, together a node's name; parent_conv_id, n_convs, n_children, n_leaves,
    n_bytes (of the last text), saved_bytes (over the subtree, n_bytes for each member but one), turn_id (the last turn).
    ``ends``: for each conversation (member) the node at which it ends. ``turns``: turn_id, role, text."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with part, turn_id and the place in the part's run of the same conv_id."""
    part = TaskContext.get().partitionId()
    last, held, seen = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        at = np.arange(n)
        new = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(start >= 0, at - start, at + held) + 1
        last, held = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array((part << 40) + seen + at), pa.array(place)],
            [*batch.schema.names, "part", "turn_id", "place"],
        )
        seen += n


def ordered(conversations: DataFrame) -> DataFrame:
    """The turns (turn_id, conv_id, pos from 1, role, text, digest, n_bytes) of every conversation in their order."""
    plain = conversations.select(
        F.col("conv_id").cast("long"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    ).filter("conv_id is not null")
    # Beginnings of role and text split turns of the same number without a range bound of a long text.
    ranges = plain.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32))
    rows = ranges.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "text", F.xxhash64("role", "text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    kinds = "conv_id long, role string, text string, digest long, n_bytes long, part int, turn_id long, place long"
    with small_batches(conversations.sparkSession, 1000):
        rows = stored(rows.mapInArrow(_numbered, kinds), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # One row at most for each part: the run that a part goes on with.
    went_on = stored(runs.select("conv_id", "part", before.alias("before")).filter("before is not null"), "runs")
    return rows.join(F.broadcast(went_on), ["conv_id", "part"], "left").select(
        "turn_id", "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text", "digest", "n_bytes"
    )


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (conv_id, depth, turn_id, digest, n_bytes), and their conv_ids."""
    own = turns.select("conv_id", F.col("pos").alias("depth"), "turn_id", "digest", "n_bytes")
    return own, turns.select("conv_id").distinct()


def share_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``sequences``, but conversation c begins with the first h turns of conversation c - c % ``every`` in place of its
    own first h; h = crc32(c) % ``most``. A conversation of fewer turns gives all, one that is absent none."""
    lens = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "lengths")
    heads = lens.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    )
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    heads = heads.join(lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("given", given)
    heads = stored(heads.drop("base_n"), "heads")
    row = ["turn_id", "digest", "n_bytes"]
    own = turns.join(heads, "conv_id").filter("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), *row)
    few = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    head = few.join(heads, "base").filter("pos <= given").select("conv_id", F.col("pos").alias("depth"), *row)
    return own.unionByName(head), lens.select("conv_id")


def _power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponent), np.int64), base, exponent.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square = square * square % prime
        left >>= 1
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, depth) with, for each modulus, the sum of terms in the chunk so far (f) and the term (t)."""
    last, held = None, [0, 0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, depth, digest, split = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "digest", "split"))
        chunk = (depth - 1) // size
        new = np.append((conv[0], chunk[0]) != last, (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        sums, terms = [], []
        for k, ((prime, base), value) in enumerate(zip((*MODULI, SPLITS), (digest, digest, split), strict=True)):
            term = (value.view(np.uint64) % np.uint64(prime)).astype(np.int64) * _power(base, depth, prime) % prime
            total = np.cumsum(term)
            before = np.where(start >= 0, total[start] - term[start], -held[k])
            sums.append((total - before) % prime)
            terms.append(term)
            held[k] = int(sums[-1][-1])
        last = (conv[-1], chunk[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, sums + terms)], [*batch.schema.names, "f1", "f2", "f3", "t1", "t2", "t3"]
        )


def fingerprinted(paths: DataFrame, bits: int, size: int) -> DataFrame:
    """Rows (conv_id, depth, turn_id, digest, n_bytes, split) with the fingerprints (fp, own) of the prefix that ends with
    the row, and of the prefix before it (up_fp, up_own)."""
    columns = ["conv_id", "depth", "turn_id", "digest", "n_bytes", "split"]
    chunk = F.floor((F.col("depth") - 1) / size)
    rows = paths.select(*columns).repartition("conv_id", chunk).sortWithinPartitions("conv_id", "depth")
    kinds = ", ".join(f"{c} long" for c in [*columns, "f1", "f2", "f3", "t1", "t2", "t3"])
    rows = stored(rows.mapInArrow(lambda batches: _prefixes(batches, size), kinds), "prefixes")
    # Sums of the whole chunks before; only conversations of over ``size`` turns have any.
    whole = rows.filter(F.col("depth") % size == 0).select("conv_id", (chunk + 1).alias("chunk"), "f1", "f2", "f3")
    upto = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    whole = whole.select("conv_id", "chunk", *[F.sum(f"f{k}").over(upto).alias(f"c{k}") for k in (1, 2, 3)])
    rows = rows.withColumn("chunk", chunk).join(stored(whole, "chunks"), ["conv_id", "chunk"], "left")
    primes = [p for p, _ in (*MODULI, SPLITS)]
    at = [(F.col(f"f{k}") + F.coalesce(f"c{k}", F.lit(0))) % p for k, p in enumerate(primes, 1)]
    up = [F.pmod(at[k - 1] - F.col(f"t{k}"), F.lit(p)) for k, p in enumerate(primes, 1)]
    both = lambda x: (x[0] * 2**31 + x[1]).bitwiseAND(F.lit(2**bits - 1))
    return rows.select(*columns, both(at).alias("fp"), at[2].alias("own"), both(up).alias("up_fp"), up[2].alias("up_own"))


def _same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & (F.col(a) == F.col(b))
    return out


def verified(paths: DataFrame, turns: DataFrame, bits: int, rounds: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with fingerprints that equal sequences alone share, and the groups (depth, fp, own; conv_id and turn_id of the
    representative, n_convs, n_bytes, up_fp, up_own)."""
    texts = turns.select("turn_id", "role", "text")
    paths = paths.withColumn("split", F.lit(0).cast("long"))
    for k in range(rounds):
        rows = stored(fingerprinted(paths, bits, size), "paths")
        groups = rows.groupBy(*KEY).agg(
            F.min(F.struct("conv_id", "turn_id", "n_bytes", "up_fp", "up_own")).alias("first"), F.count(F.lit(1)).alias("n_convs")
        )
        groups = stored(groups.select(*KEY, "first.*", "n_convs"), "groups")
        first = groups.filter("n_convs > 1").select(*KEY, *[F.col(c).alias(f"first_{c}") for c in ("turn_id", "up_fp", "up_own")])
        other = rows.select("conv_id", "turn_id", "up_fp", "up_own", *KEY).join(first, KEY)
        before = _same(("up_fp", "first_up_fp"), ("up_own", "first_up_own"))
        # Those with another turn than the representative, or with another prefix before it.
        other = stored(other.filter(~before | (F.col("turn_id") != F.col("first_turn_id"))).withColumn("before", before), "unlike")
        pairs = other.filter("before").select("turn_id", "first_turn_id").distinct()
        named = texts.select(*[F.col(c).alias(f"first_{c}") for c in texts.columns])
        unlike = pairs.join(texts, "turn_id").join(named, "first_turn_id")
        unlike = stored(unlike.filter(~_same(("role", "first_role"), ("text", "first_text"))).select("turn_id", "first_turn_id"), "unlike")
        bad = other.filter("not before").select("conv_id", "depth", "turn_id", "up_fp", "up_own").unionByName(
            other.filter("before").join(unlike, ["turn_id", "first_turn_id"], "left_semi").select("conv_id", "depth", "turn_id", "up_fp", "up_own")
        )
        if bad.isEmpty():
            return rows, groups
        # A number that only the turn's text, the prefix before and the round decide.
        number = F.xxhash64(F.lit(k), F.sha2(F.concat_ws("\0", "role", "text"), 256), "up_fp", "up_own")
        bad = bad.join(texts, "turn_id").select("conv_id", "depth", number.alias("number"))
        paths = rows.join(stored(bad, "splits"), ["conv_id", "depth"], "left").withColumn(
            "split", F.when(F.col("number").isNull(), F.col("split")).otherwise(F.xxhash64("split", "number"))
        )
    raise RuntimeError(f"fingerprints still meet after {rounds} rounds; take more bits")


def prefix_trie(paths: DataFrame, ids: DataFrame, turns: DataFrame, bits: int = 62, rounds: int = 20, size: int = CHUNK) -> Trie:
    """The trie of sequences (``paths``: conv_id, depth from 1, turn_id, digest, n_bytes) of the conversations ``ids``, which
    may have none. ``bits`` of a fingerprint are used; with few, groups collide and are split by their texts.
    ``size``: turns of a conversation that one scan sums up."""
    rows, groups = verified(paths, turns, bits, rounds, size)
    zero = F.lit(0).cast("long")
    top = ids.select("conv_id", *[zero.alias(c) for c in KEY])
    rows = rows.select("conv_id", *KEY).unionByName(top)
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    groups = groups.unionByName(root.select("conv_id", "n_convs", *[zero.alias(c) for c in KEY], zero.alias("n_bytes")), allowMissingColumns=True)
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_fp").alias("fp"), F.col("up_own").alias("own")]
    children = groups.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.join(stored(children, "children"), KEY, "left").fillna({"n_children": 0})
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    # A conversation's nodes are those that it represents: from some depth on all of its prefixes.
    mine = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    mine = stored(mine, "represented")
    sums = rows.join(mine, "conv_id").groupBy(*KEY).agg(F.sum("all").alias("all"), F.sum("leaves").alias("n_leaves"))
    # Of what its representative carries, a node leaves out the nodes above it: sums in chunks, and of the chunks before.
    chunk = F.floor(F.col("depth") / size)
    above = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    inner = nodes.withColumn("chunk", chunk).withColumn("above", F.coalesce(F.sum("saved").over(above), zero))
    whole = nodes.groupBy("conv_id", chunk.alias("chunk")).agg(F.sum("saved").alias("whole"))
    upto = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("conv_id", "chunk", F.sum("whole").over(upto).alias("chunks")).filter("chunks is not null")
    inner = inner.join(stored(whole, "chunks"), ["conv_id", "chunk"], "left")
    inner = inner.withColumn("above", F.col("above") + F.coalesce("chunks", zero)).drop("chunk", "chunks")
    full = inner.join(stored(sums, "subtrees"), KEY).withColumn("saved_bytes", F.col("all") - F.col("above"))
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("p_depth"), F.col("fp").alias("p_fp"), F.col("own").alias("p_own"))
    full = full.join(parents, (F.col("depth") - 1 == F.col("p_depth")) & _same(("up_fp", "p_fp"), ("up_own", "p_own")), "left")
    last = rows.groupBy(F.col("conv_id").alias("member")).agg(F.max(F.struct(*KEY)).alias("at")).select("member", "at.*")
    ends = stored(last, "ends").join(nodes.select("conv_id", *KEY), KEY).select("member", "conv_id", "depth")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "n_bytes", "saved_bytes", "turn_id"]
    return Trie(stored(full.select(*columns), "trie"), ends, turns.select("turn_id", "role", "text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, depth, block, ids) sorted, to one digest for each (conv_id, depth); text is hashed as it comes."""
    key, digest, out = None, None, []
    for batch in batches:
        for conv_id, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv_id, depth) == key:
                digest.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = (conv_id, depth), hashlib.sha256(ids.encode())
    if key:
        out.append((*key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
        ["conv_id", "depth", "ends_sha256"],
    )


def ends_digest(ends: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the members that end at a node, ascending and comma-joined.

    Members are joined in blocks of at most ``block`` numbers; a task gets a node's blocks one after the other."""
    some = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / block).alias("block")).agg(F.array_sort(F.collect_list("member")).alias("ids"))
    some = some.select("conv_id", "depth", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    some = some.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return some.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def node_rows(trie: Trie) -> DataFrame:
    """One row per node, with a digest of the conversations that end there."""
    with small_batches(trie.nodes.sparkSession):
        digests = stored(ends_digest(trie.ends), "digests")
    rows = trie.nodes.join(digests, ["conv_id", "depth"], "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after ``share_heads``, one row per node."""
    turns = ordered(conversations)
    paths, ids = share_heads(turns)
    return node_rows(prefix_trie(paths, ids, turns))
