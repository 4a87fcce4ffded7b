"""The keyed store kept up by a stream: one entry for each (kind, key), which a timer ends with its time to live.

Input rows are operations (kind, key, op, at, seq, scope, value, ttl): op is ``write``, ``read`` or ``delete``, at is a time
and seq orders operations of one time. A write makes a new entry; a read of one that is not over its time counts and renews
the time of access; an entry over its time is gone. The stream gives a change for each operation that had an effect, and one
for each entry whose time ran out. Operations may come as late as the watermark allows, but a batch takes its own in order.

Keys are dealt by hash over a fixed number of buckets. A state holds the entries of a bucket, one for each key whatever the
number of operations, and a bucket's operations of a batch are taken at once as arrays, with no call for each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A table of entries as an Arrow stream.
STATE = "entries binary"
ENTRY = pa.schema({
    "kind": pa.string(), "key": pa.string(), "scope": pa.string(), "value": pa.string(), "created": pa.float64(), "accessed": pa.float64(),
    "access_count": pa.int32(), "ttl": pa.int32(), "seq": pa.int64(),
})
#: Buckets of keys; a checkpoint keeps the number that it began with.
BUCKETS = 256
CHANGE = "kind string, key string, change string, changed double, scope string, value string, created double, accessed double, access_count int, ttl int, seq long"


def applied(entry: tuple | None, op: str, at: float, seq: int, scope: Any, value: Any, ttl: int) -> tuple[tuple | None, str | None]:
    """The entry after an operation, and what happened: written, read, expired, deleted or nothing."""
    if op == "write":
        return (scope, value, at, at, 0, ttl, seq), "written"
    if entry is None:
        return None, None
    if op == "delete":
        return None, "deleted"
    if at > entry[2] + entry[5]:
        return None, "expired"
    return (*entry[:3], max(at, entry[3]), entry[4] + 1, entry[5], seq), "read"


COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]


def _packed(entries: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(entries, ENTRY, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpacked(state: GroupState) -> pd.DataFrame:
    if not state.exists:
        return ENTRY.empty_table().to_pandas()
    return pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    first, *others = (pd.factorize(c, use_na_sentinel=False)[0].astype("int64") for c in columns)
    for c in others:
        first = first * (c.max(initial=0) + 1) + c
    return first


def batch(entries: pd.DataFrame, ops: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The changes by a batch of operations, as ``applied`` makes them one by one, and the entries that it leaves. Entries that
    have no operation and were over their time before ``watermark`` (in ms) end too.

    Of each key, in order: its entry, if it has one, then the operations. From an entry or a write up to the next write,
    reads count until the first delete, or read after the entry's time, which ends the entry.
    """
    n, m = len(entries), len(ops)
    both = lambda old, new: np.concatenate([entries[old].to_numpy(), ops[new].to_numpy()])
    key = _codes(both("kind", "kind").astype(object), both("key", "key").astype(object))
    op = ops["op"].to_numpy(object)
    held = np.arange(n + m) < n
    at, seq = both("created", "at").astype(float), both("seq", "seq").astype("int64")
    order = np.lexsort((seq, at, ~held, key))
    key, held, at, seq = key[order], held[order], at[order], seq[order]
    write, delete = (np.concatenate([np.zeros(n, bool), op == x])[order] for x in ("write", "delete"))
    starts = held | write
    fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    heads = np.flatnonzero(starts | fresh)
    sizes = np.diff(np.append(heads, n + m))
    head = np.repeat(heads, sizes)  # the row of the entry or write that a row follows
    ttl = np.concatenate([entries["ttl"].to_numpy("int64"), ops["ttl"].fillna(0).to_numpy("int64")])[order]
    count = np.concatenate([entries["access_count"].to_numpy("int64"), np.zeros(m, "int64")])[order]
    accessed = np.concatenate([entries["accessed"].to_numpy(float), ops["at"].to_numpy(float)])[order]

    ends = starts[head] & ~starts & (delete | (at > at[head] + ttl[head]))
    upto = np.cumsum(ends)
    before = upto - ends - upto[head]  # ends in the entry's time before a row; a head ends nothing
    live = starts[head] & (before == 0)
    place = np.arange(n + m)
    count = count[head] + (place - head) - ends
    accessed = np.maximum(at, accessed[head])
    accessed[heads] = np.concatenate([entries["accessed"].to_numpy(float), ops["at"].to_numpy(float)])[order][heads]
    last = place - ends  # the row whose entry a row shows: an end shows the one before
    scope, value = (both(c, c).astype(object)[order] for c in ("scope", "value"))
    kinds, keys = (both(c, c).astype(object)[order] for c in ("kind", "key"))

    def shown(i: np.ndarray) -> dict[str, np.ndarray]:
        h = head[i]
        return {
            "kind": kinds[i], "key": keys[i], "scope": scope[h], "value": value[h], "created": at[h], "accessed": accessed[last[i]],
            "access_count": count[i].astype("int32"), "ttl": ttl[h].astype("int32"), "seq": seq[last[i]],
        }

    changed = np.flatnonzero(live & ~held)
    names = np.where(write, "written", np.where(delete, "deleted", np.where(ends, "expired", "read")))
    made = pd.DataFrame(shown(changed) | {"change": names[changed].astype(object), "changed": at[changed]})
    tails = heads + sizes - 1
    tails = tails[(np.append(fresh[heads[1:]], True) if len(heads) else fresh) & starts[heads] & (upto[tails] == upto[heads])]
    over = held[tails] & (due(at[tails], ttl[tails]) < watermark)
    left = shown(tails[~over])
    timed = shown(tails[over])
    timed = pd.DataFrame(timed | {"change": np.full(over.sum(), "expired", object), "changed": timed["created"] + timed["ttl"]})
    return pd.concat([made, timed])[COLUMNS] if over.any() else made[COLUMNS], pd.DataFrame(left)


def due(created: np.ndarray, ttl: np.ndarray) -> np.ndarray:
    """The first millisecond at which entries are over their time."""
    return ((created + ttl) * 1000).astype("int64") + 1


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of a bucket by its operations of a batch and by the timer. State comes and goes with the rows."""
    names = ["kind", "key", "op", "at", "seq", "scope", "value", "ttl"]
    ops = pd.DataFrame(columns=names) if state.hasTimedOut else pd.concat([f[names] for f in frames], ignore_index=True)
    changes, entries = batch(_unpacked(state), ops, state.getCurrentWatermarkMs())
    if len(entries):
        state.update((_packed(entries),))
        # An entry that is over its time by now goes with the next batch.
        state.setTimeoutTimestamp(max(int(due(entries["created"].to_numpy(), entries["ttl"].to_numpy()).min()), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if len(changes):
        yield changes


def changes(operations: DataFrame, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The stream of changes to the store by a stream of operations whose ``at`` is a timestamp."""
    rows = operations.withColumn("event_time", F.col("at")).withWatermark("event_time", late)
    rows = rows.withColumn("at", F.col("at").cast("timestamp").cast("double"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(step, CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def entries(log: DataFrame, now: float | None = None) -> DataFrame:
    """The entries that a log of changes leaves: of each key the last change, unless it ended the entry or its time is over
    at ``now``. A change that a restart wrote twice counts once."""
    # Among changes of one time a later operation comes last, and the end of an entry after its other changes.
    rank = F.struct("changed", "seq", F.col("change").isin("expired", "deleted").cast("int"))
    last = log.groupBy("kind", "key").agg(F.max_by(F.struct("change", "scope", "value", "created", "accessed", "access_count", "ttl"), rank).alias("e"))
    live = last.filter(~F.col("e.change").isin("expired", "deleted"))
    if now is not None:
        live = live.filter(F.lit(now) - F.col("e.created") <= F.col("e.ttl"))
    return live.select("kind", "key", *[f"e.{c}" for c in ("scope", "value", "created", "accessed", "access_count", "ttl")])
