"""Readers and writers: files by format, directories of series, SQL over files, news feeds, reports, logs.

Readers take explicit schemas where they are given and infer types only on request. NaN becomes null once, at the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text", "xml": "xml"}
BARS = "timestamp timestamp, open double, high double, low double, close double, volume double"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns as null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in floats})


def read(spark: SparkSession, path: str, schema: str | None = None, format: str | None = None, **options: str) -> DataFrame:
    """A file or directory by its extension. CSV has a header; JSON is one object a line unless ``multiLine`` is set."""
    kind = format or READERS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path!r}")
    r = spark.read.options(**options)
    if kind == "csv":
        r = r.option("header", options.get("header", "true")).option("sep", "\t" if path.endswith(".tsv") else options.get("sep", ","))
        r = r if schema else r.option("inferSchema", options.get("inferSchema", "true"))
    r = r.schema(schema) if schema else r
    return nan_to_null(r.format(kind).load(path))


def read_series(spark: SparkSession, path: str, schema: str = BARS, suffix: str = "_ml_ready.csv") -> DataFrame:
    """All ``<ticker><suffix>`` files of a directory as one table with the ticker from the file's name."""
    df = spark.read.schema(schema).option("header", "true").option("pathGlobFilter", f"*{suffix}").csv(path)
    name = F.regexp_extract("_metadata.file_name", r"^(?:features_)?(.*)" + suffix.replace(".", r"\.") + "$", 1)
    return nan_to_null(df.select(name.alias("ticker"), *df.columns))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there, on whatever file system it names."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths} is there")


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """SQL over files (``parquet.`path` ``) and the given frames, by their names in braces."""
    return spark.sql(query, **tables)


def describe_file(spark: SparkSession, path: str) -> DataFrame:
    """Column names and inferred types."""
    return spark.createDataFrame(read(spark, path).dtypes, "column string, type string")


def checked_name(name: str) -> str:
    if not name.replace("_", "").isalnum() or name[0].isdigit():
        raise ValueError(f"not a table name: {name!r}")
    return name


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table by JDBC; partition it with column, lower and upper bound and number of partitions as options."""
    return spark.read.format("jdbc").options(url=url, dbtable=checked_name(table), **options).load()


def read_catalog(text: str) -> dict:
    """A catalog of ``key: value`` lines and ``- item`` lists with start, end and tickers."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if line.lstrip().startswith("- ") and key:
            out.setdefault(key, [])
            out[key] = [*(out[key] or []), line.lstrip()[2:].strip().strip("\"'")]
        elif ":" in line:
            key, _, value = (x.strip() for x in line.partition(":"))
            out[key] = value.strip("\"'") or None
    missing = [k for k in ("start", "end", "tickers") if not out.get(k)]
    if missing:
        raise ValueError(f"the catalog lacks {', '.join(missing)}")
    return out


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: ts (UTC), title, body, source."""
    schema = "title string, description string, pubDate string, link string"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    date = F.regexp_replace("pubDate", "^[A-Za-z]+, *", "")
    ts = F.coalesce(*[F.try_to_timestamp(date, F.lit(f"d MMM yyyy HH:mm:ss {z}")) for z in ("xx", "z")], F.try_to_timestamp("pubDate"))
    return df.select(ts.alias("ts"), "title", F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]*>", "").alias("body"), F.coalesce(F.parse_url("link", F.lit("HOST")), F.lit("")).alias("source"))


def news(raw: DataFrame, ticker: str | None = None, body: int = 2000) -> DataFrame:
    """News with a date in UTC, a trimmed body and a key of url or title; the first of each key stays. Rows whose date
    cannot be read are dropped; with a ticker, only news that name it."""
    d = raw.withColumns({"ts": F.to_utc_timestamp(F.try_to_timestamp(F.col("ts").cast("string")), "UTC"), "body": F.substring(F.coalesce("body", F.lit("")), 1, body)})
    d = d.filter("ts is not null")
    if ticker:
        d = d.filter(F.upper(F.concat_ws(" ", "title", "body")).contains(ticker.upper()))
    url = F.col("url") if "url" in raw.columns else F.lit(None).cast("string")
    d = d.withColumn("key", F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce("title", F.lit(""))), 256))
    first = d.groupBy("key").agg(F.min_by(F.struct(*d.columns), F.struct("ts", "title", "body")).alias("r"))
    return first.select("r.*").withColumn("date", F.to_date("ts"))


def windows(start: str, end: str, days: int = 90) -> list[tuple[str, str]]:
    """Consecutive date ranges of at most ``days`` days that cover start to end."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    out = []
    while a <= b:
        c = min(a + timedelta(days=days - 1), b)
        out.append((a.isoformat(), c.isoformat()))
        a = c + timedelta(days=1)
    return out


def abstract_text(inverted: DataFrame) -> DataFrame:
    """Abstracts from inverted indices (id, word, positions): words by position, joined."""
    p = inverted.select("id", "word", F.explode("positions").alias("at"))
    return p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("abstract"))


def write_series(df: DataFrame, path: str, format: str = "parquet") -> None:
    """By ticker, in time order within files."""
    df.repartition("ticker").sortWithinPartitions("ticker", "timestamp").write.mode("overwrite").partitionBy("ticker").format(format).save(path)


def write_all(tables: dict[str, DataFrame], path: str) -> None:
    """All tables or none: each is written beside its place, and all are moved once all are there."""
    from uuid import uuid4

    spark = next(iter(tables.values())).sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    stage = f"{path.rstrip('/')}/_stage-{uuid4().hex}"
    fs = path_of(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{checked_name(name)}")
        for name in tables:
            fs.delete(path_of(f"{path}/{name}"), True)
            fs.rename(path_of(f"{stage}/{name}"), path_of(f"{path}/{name}"))
    finally:
        fs.delete(path_of(stage), True)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, last: int | None = None, time: str = "ts") -> DataFrame:
    """A log of JSON lines; lines that cannot be read are left out. ``last``: the latest rows only."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return d if last is None else d.orderBy(F.desc(time)).limit(last)


def markdown(report: DataFrame, rows: int = 1000) -> str:
    """A small report as a Markdown table; one of over ``rows`` rows is refused, since it would pass through the driver."""
    names = report.columns
    got = report.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of over {rows} rows; write it as files")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got])


def write_report(report: DataFrame, path: str, title: str, rows: int = 1000) -> None:
    """A small report as ``report.csv`` (a directory of one part) and ``report.md`` under a path."""
    text = f"# {title}\n\n{markdown(report, rows)}\n"
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/report.csv")
    spark = report.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/report.md")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the session's tables and views, in order."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name")).distinct().orderBy("name")


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """(column, type) of a table or view; the name is checked before it becomes SQL."""
    return spark.sql(f"DESCRIBE TABLE {checked_name(name)}").select(F.col("col_name").alias("column"), F.col("data_type").alias("type"))


def news_key(url: Column, title: Column) -> Column:
    """SHA-256 of the address, or of the title where there is no address."""
    return F.sha2(F.coalesce(F.nullif(url, F.lit("")), title, F.lit("")), 256)


def news_page(articles: DataFrame, body: int = 2000) -> DataFrame:
    """(ts, title, body, source) of a page of articles (ts, title, body, source, is_duplicate): flagged ones and those
    without title or date go, texts are trimmed, the earliest of each title stays."""
    d = articles.filter(~F.coalesce("is_duplicate", F.lit(False)) & (F.trim("title") != ""))
    d = d.select(F.try_to_timestamp(F.col("ts").cast("string")).alias("ts"), F.trim("title").alias("title"), F.substring(F.trim(F.coalesce("body", F.lit(""))), 1, body).alias("body"), F.coalesce("source", F.lit("")).alias("source"))
    first = d.filter("ts is not null").groupBy("title").agg(F.min(F.struct("ts", "body", "source")).alias("r"))
    return first.select("r.ts", "title", "r.body", "r.source")


def merge_news(previous: DataFrame, page: DataFrame) -> DataFrame:
    """What was there, and of the page the titles that were not."""
    return previous.unionByName(page.join(previous.select("title"), "title", "left_anti").select(*previous.columns))


def daily_count(articles: DataFrame) -> DataFrame:
    """Articles by day, each (url, title) once."""
    d = articles.withColumn("key", news_key(F.col("url"), F.col("title")))
    first = d.groupBy("key").agg(F.min(F.to_date(F.try_to_timestamp(F.col("ts").cast("string")))).alias("date"))
    return first.groupBy("date").agg(F.count(F.lit(1)).alias("count"))


PAPER = "title string, abstract string, authors array<string>, year int, url string, doi string, citations long, source string"
WORK = """struct<results:array<struct<display_name:string,publication_year:int,id:string,doi:string,cited_by_count:bigint,
abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string>>>>"""


def works(responses: DataFrame, column: str = "json") -> DataFrame:
    """Papers (``PAPER``) of JSON responses with ``results``, one response a row; what is not JSON gives none."""
    w = responses.select(F.explode(F.from_json(column, WORK)["results"]).alias("w")).select("w.*")
    placed = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("word")))))
    abstract = F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    doi = F.nullif(F.lower(F.replace("doi", F.lit("https://doi.org/"), F.lit(""))), F.lit(""))
    return w.select(
        F.trim(F.coalesce("display_name", F.lit(""))).alias("title"), F.trim(F.coalesce(abstract, F.lit(""))).alias("abstract"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.col("publication_year").alias("year"), F.coalesce("primary_location.landing_page_url", "id").alias("url"), doi.alias("doi"), F.col("cited_by_count").alias("citations"), F.lit("works").alias("source"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers (``PAPER``) of Atom feeds."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    d = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return d.select(
        text("title").alias("title"), text("summary").alias("abstract"), F.coalesce(F.transform("author", lambda a: F.trim(F.coalesce(a["name"], F.lit("")))), F.array().cast("array<string>")).alias("authors"),
        F.try_to_number(F.substring("published", 1, 4), F.lit("9999")).cast("int").alias("year"), text("id").alias("url"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("long").alias("citations"), F.lit("atom").alias("source"),
    )


def text_sources(spark: SparkSession, root: str, table: list[tuple[str, str, bool, tuple[str, ...] | None]], excluded: tuple[str, ...] = ()) -> DataFrame:
    """(source, text) of files by a table of (directory, pattern, recursive, endings): a file that several rows name
    comes once, by the first. Directories that are not there are skipped, and paths that hold an excluded part."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/")
    out = None
    for n, (directory, pattern, recursive, endings) in enumerate(table):
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{directory}")):
            continue
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(f"{top}/{directory}")
        d = files.select(F.lit(n).alias("n"), F.substring("path", len(top) + 2, 10_000).alias("source"), F.decode("content", "UTF-8").alias("text"))
        for part in excluded:
            d = d.filter(~F.concat(F.lit("/"), "source").contains(part))
        if endings:
            d = d.filter(F.regexp_extract("source", r"(\.[^./]*)$", 1).isin(list(endings)))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "source string, text string")
    return out.groupBy("source").agg(F.min_by("text", "n").alias("text"))


def datasets(spark: SparkSession, root: str, stages: tuple[str, ...] = ("raw", "interim", "processed")) -> DataFrame:
    """(stage, name, bytes) of the files below the stage directories that are there."""
    out = None
    for stage in stages:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{stage}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{stage}")
            d = files.select(F.lit(stage).alias("stage"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
            out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "stage string, name string, bytes long")


def score_onnx(df: DataFrame, model: bytes, columns: list[str], output: str = "score") -> DataFrame:
    """Scores of an ONNX model over float columns, in Arrow batches; the model travels with the task."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model)
        name = session.get_inputs()[0].name
        for f in frames:
            y = session.run(None, {name: f[columns].to_numpy("float32")})[0]
            yield f.assign(**{output: y.reshape(len(f), -1)[:, -1].astype(float)})

    return df.mapInPandas(run, df.schema.add(output, "double"))
