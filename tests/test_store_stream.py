"""The streamed store against operations applied one by one, over several batches and a restart."""

import datetime
import random

from pyspark.sql import functions as F

from veldrift.streaming import store

START = datetime.datetime(2024, 1, 1)
SCHEMA = "kind string, key string, op string, at timestamp, seq long, scope string, value string, ttl int"


def operations(n=400, seed=0):
    rng = random.Random(seed)
    return [
        ("k", f"u{rng.randrange(12)}", rng.choice(["write", "read", "read", "delete" if rng.random() < 0.2 else "read"]), START + datetime.timedelta(minutes=5 * i), i, "s", f"v{i}", rng.choice([600, 3600, 20_000]))
        for i in range(n)
    ]


def by_hand(rows, now):
    held = {}
    for kind, key, op, at, seq, scope, value, ttl in rows:
        t = at.replace(tzinfo=datetime.timezone.utc).timestamp()
        held[kind, key], _ = store.applied(held.get((kind, key)), op, t, seq, scope, value, ttl)
    return sorted((*k, *e[:6]) for k, e in held.items() if e is not None and now - e[2] <= e[5])


def run(spark, source, out, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = store.changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_operations_one_by_one(spark, tmp_path):
    rows = operations()
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    now = rows[-1][3].replace(tzinfo=datetime.timezone.utc).timestamp()
    for k in range(4):  # the stream ends after two parts and goes on from its checkpoint with the others
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            run(spark, source, out, state)
    log = spark.read.parquet(out)
    got = sorted(tuple(r) for r in store.entries(log, now).collect())
    assert got == by_hand(rows, now) and 0 < len(got) < 12
    assert log.filter("change = 'expired'").count() > 5 and log.filter("change = 'deleted'").count() > 0
    assert log.filter(F.col("change") == "written").count() == sum(r[2] == "write" for r in rows)
    # A replay of the whole log changes nothing.
    assert sorted(tuple(r) for r in store.entries(log.unionByName(log), now).collect()) == got


def test_state_comes_with_the_rows(spark):
    """No call to the state's server for each key: the plan has grouped state."""
    stream = spark.readStream.schema(SCHEMA).parquet("/tmp")
    assert "FlatMapGroupsInPandasWithState" in store.changes(stream)._jdf.queryExecution().logical().toString()
