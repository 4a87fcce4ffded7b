"""Queries that go through the library's readers and writers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prefix
from ..sources import files
from ..streaming import events, store
from .adapters import bars, table
from .registry import Registry

R = Registry()


def round_trip(kind: str):
    """Nations written and read again in a format."""

    def query(s, d: str) -> DataFrame:
        path = f"{prefix.scratch(s, kind)}.{kind}"
        w = table(s, d, "nation").write
        (w.option("header", "true") if kind == "csv" else w).format(kind).save(path)
        return files.read(s, path, schema="n_nationkey int, n_name string, n_regionkey int")

    return query


for kind in ("csv", "json", "parquet", "orc"):
    R.table(f"source_{kind}", round_trip(kind), "", "nation", dict.fromkeys(["n_nationkey", "n_name", "n_regionkey"]))


def sql_over_files(s, d: str) -> DataFrame:
    return files.sql(s, f"SELECT n.r_name, count(*) AS n FROM parquet.`{d}/nation.parquet` JOIN {{r}} n ON n_regionkey = n.r_regionkey GROUP BY 1", r=table(s, d, "region"))


R.table("sql_over_files", sql_over_files, "", "(SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)", {"r_name": None, "n": None})
R.rows_only("describe_file", lambda s, d: files.describe_file(s, f"{d}/orders.parquet"))


def series(s, d: str) -> DataFrame:
    """Bars written by ticker and read again from one directory."""
    path = prefix.scratch(s, "series")
    files.write_series(bars(s, d), path)
    return s.read.parquet(path).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high"))


R.table(
    "series_sink", series, "", "(SELECT l_returnflag AS ticker, count(DISTINCT CAST(l_shipdate AS DATE)) AS n, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY 1)", dict.fromkeys(["ticker", "n", "high"]),
)


def news(s, d: str) -> DataFrame:
    """Documents as raw news: repeated titles go, dates are read."""
    raw = table(s, d, "documents").select(
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("ts"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), "source"
    )
    return files.news(raw).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


R.table(
    "news_clean", news, "t AS (SELECT split_part(text, chr(10), 1) AS title, min('2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS ts FROM documents GROUP BY 1)",
    "(SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM t GROUP BY 1)", {"date": None, "n": None},
)


def stream(s, d: str) -> DataFrame:
    """Daily bars of the event stream, run to its end."""
    at = prefix.scratch(s, "stream")
    out = f"{at}/out"
    source = f"{at}/in"
    table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(source)
    q = events.bars(events.read_events(s, source), late="60 days").writeStream.format("memory").queryName("t" + uuid.uuid4().hex).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    s.table(q.name).write.parquet(out)
    s.catalog.dropTempView(q.name)
    return s.read.parquet(out)


R.table(
    "streamed_bars", stream, "",
    """(SELECT event_type AS ticker, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS "timestamp", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)""",
    dict.fromkeys(["ticker", "timestamp", "open", "high", "low", "close", "volume"]),
)


def stored_stream(s, d: str) -> DataFrame:
    """The store at the end of a stream of events, taken as writes, reads and deletes of their type and user."""
    at, i = prefix.scratch(s, "store"), F.col("event_id")
    op = F.when(i % 5 < 2, "write").when(i % 35 == 4, "delete").otherwise("read")
    ops = table(s, d, "events").select(
        F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), op.alias("op"), F.col("ts").cast("timestamp").alias("at"), i.alias("seq"),
        F.lit("global").alias("scope"), F.concat(F.lit("v"), i.cast("string")).alias("value"), (86_400 * (1 + i % 5)).cast("int").alias("ttl"),
    )
    moment = F.unix_micros("at")
    cuts = ops.agg(F.percentile_approx(moment, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first().c or [None, None]
    batch = F.when(moment > F.lit(cuts[1]), 2).when(moment > F.lit(cuts[0]), 1).otherwise(0)
    for k in range(3):  # three batches in order of time; the stream goes on from its checkpoint
        ops.filter(batch == k).write.mode("append").parquet(f"{at}/in")
        stream = s.readStream.schema(ops.schema).parquet(f"{at}/in")
        q = store.changes(stream, late="60 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    now = ops.agg(F.max(F.col("at").cast("double"))).first()[0]
    live = store.entries(s.read.schema(store.CHANGE).parquet(f"{at}/out"), now)
    return live.select("kind", "key", "value", "access_count", "ttl", (F.lit(now) - F.col("created")).alias("age"), (F.lit(now) - F.col("accessed")).alias("idle"))


R.table(
    "store_stream", stored_stream,
    """o AS (SELECT event_type AS kind, 'u' || user_id AS key, CASE WHEN event_id % 5 < 2 THEN 'write' WHEN event_id % 35 = 4 THEN 'delete' ELSE 'read' END AS op, epoch(ts) AS moment, event_id AS seq, 'v' || event_id AS value, CAST(86400 * (1 + event_id % 5) AS INTEGER) AS ttl FROM events),
    e AS (SELECT kind, key, max((moment, seq)) FILTER (op = 'write') AS w, max((moment, seq)) FILTER (op = 'delete') AS gone, (SELECT max(moment) FROM o) AS now FROM o GROUP BY 1, 2),
    live AS (SELECT e.kind, e.key, o.value, o.ttl, o.moment, o.seq, now FROM e JOIN o ON o.seq = e.w[2] WHERE (gone IS NULL OR gone < w) AND now - o.moment <= o.ttl),
    counted AS (SELECT live.kind, live.key, live.value, live.ttl, now - live.moment AS age, CAST(count(o.seq) AS INTEGER) AS access_count, now - greatest(live.moment, coalesce(max(o.moment), live.moment)) AS idle
      FROM live LEFT JOIN o ON o.kind = live.kind AND o.key = live.key AND o.op = 'read' AND (o.moment, o.seq) > (live.moment, live.seq) AND o.moment <= live.moment + live.ttl GROUP BY live.kind, live.key, live.value, live.ttl, live.moment, now)""",
    "counted", {"kind": None, "key": None, "value": None, "access_count": None, "ttl": None, "age": 3, "idle": 3},
)
