"""Batches of the store's operations as arrays against the same operations one by one."""

import random

import pandas as pd

from veldrift.streaming import store

NAMES = ["kind", "key", "op", "at", "seq", "scope", "value", "ttl"]


def one_by_one(held, ops):
    changes = []
    for kind, key, op, at, seq, scope, value, ttl in sorted(ops, key=lambda r: (r[3], r[4])):
        last = held.get((kind, key))
        entry, change = store.applied(last, op, at, seq, scope, value, ttl)
        held[kind, key] = entry
        if change:
            changes.append((kind, key, change, at, *(entry or last)))
    return changes


def test_batches_equal_operations_one_by_one():
    rng = random.Random(4)
    held, entries, ended = {}, store.ENTRY.empty_table().to_pandas(), 0
    for b in range(40):
        n = rng.choice([0, 1, 5, 80])
        # Times of a batch may lie before those of the one before; several operations may share a time.
        ops = [(rng.choice("xy"), f"u{rng.randrange(9)}", rng.choice(["write", "read", "read", "read", "delete"]), float(100 * b + rng.randrange(-60, 90)), 1000 * b + i, rng.choice(["s", None]), f"v{i}", rng.choice([20, 60, 900])) for i in range(n)]
        mark = (100 * b - 200) * 1000
        touched = {r[:2] for r in ops}
        expected = one_by_one(held, ops)
        for k, e in list(held.items()):
            if e is not None and k not in touched and int((e[2] + e[5]) * 1000) + 1 < mark:
                expected.append((*k, "expired", e[2] + e[5], *e))
                held[k] = None
        made, entries = store.batch(entries, pd.DataFrame(ops, columns=NAMES), mark)
        order = lambda rows: sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)
        assert order(made.astype(object).itertuples(index=False)) == order(expected)
        assert order(entries.astype(object).itertuples(index=False)) == order((*k, *e) for k, e in held.items() if e is not None)
        ended += sum(r[2] == "expired" for r in expected)
    assert ended > 20


def test_a_state_holds_many_keys(spark, tmp_path):
    """More keys than buckets: the number of states is that of the buckets, not of the keys."""
    rows = spark.range(3000).selectExpr("'k' as kind", "concat('u', id) as key", "'write' as op", "timestamp_seconds(1700000000 + id) as at", "id as seq", "'s' as scope", "'v' as value", "100000 as ttl")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = store.changes(stream, buckets=16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 16
    assert store.entries(spark.read.parquet(str(tmp_path / "out"))).count() == 3000
