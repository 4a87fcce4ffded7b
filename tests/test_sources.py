import pytest

from veldrift.operators import graphs, profiling, retrieval
from veldrift.sources import files


def test_csv_series_directory(spark, tmp_path):
    for t in ("AAA", "BBB"):
        (tmp_path / f"features_{t}_ml_ready.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-02,1,2,0.5,NaN,7\n2024-01-03,1,2,0.5,1.5,8\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = files.read_series(spark, str(tmp_path)).orderBy("ticker", "timestamp").collect()
    assert [r.ticker for r in got] == ["AAA", "AAA", "BBB", "BBB"] and got[0].close is None and got[1].close == 1.5


def test_reader_by_extension(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        files.read(spark, "x.unknown")
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.json")]).endswith("a.json")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><description>&lt;b&gt;x&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><link>https://a.example/x</link></item></channel></rss>")
    r = files.read_rss(spark, str(tmp_path / "f.xml")).first()
    assert (r.title, r.body, r.source) == ("T", "x", "a.example")


def test_catalog_and_windows():
    c = files.read_catalog("start: 2020-01-01\nend: 2021-01-01 # last\ntickers:\n  - AAA\n  - BBB\n")
    assert c["tickers"] == ["AAA", "BBB"]
    with pytest.raises(ValueError, match="end, tickers"):
        files.read_catalog("start: 2020-01-01\n")
    w = files.windows("2024-01-01", "2024-07-01")
    assert w[0] == ("2024-01-01", "2024-03-30") and w[-1][1] == "2024-07-01" and len(w) == 3


def test_write_all_or_nothing(spark, tmp_path):
    good = spark.range(3)
    files.write_all({"a": good, "b": good}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
    bad = spark.range(3).selectExpr("raise_error('no') as x")
    with pytest.raises(Exception, match="no"):
        files.write_all({"a": spark.range(9), "b": bad}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3 and not list(tmp_path.glob("_stage*"))


def test_log_skips_broken_lines(spark, tmp_path):
    p = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([(1.0, "a"), (2.0, "b")], "ts double, action string"), p)
    (tmp_path / "log" / "part-x.json").write_text('{"ts": 3.0, "action": "c"}\n{broken\n')
    got = files.read_log(spark, p, "ts double, action string", last=2).collect()
    assert [r.action for r in got] == ["c", "b"]


def test_abstracts(spark):
    d = spark.createDataFrame([(1, "a", [0, 2]), (1, "b", [1])], "id int, word string, positions array<int>")
    assert files.abstract_text(d).first().abstract == "a b a"


def test_findings(spark):
    rows = [(1, f"id{i}", "x" if i % 2 else "y", float(i % 7) if i < 99 else 500.0) for i in range(100)]
    d = spark.createDataFrame(rows, "const int, id string, cat string, v double")
    got = {(r.column, r.kind) for r in profiling.findings(d).collect()}
    assert got == {("const", "constant"), ("id", "high_cardinality"), ("v", "outliers")}
    assert profiling.schema_check(d, {"id": "string", "cat": "int", "z": "int"}) == [("cat", "int", "string"), ("z", "int", "missing"), ("const", "extra", "int"), ("v", "extra", "double")]


def test_normality_and_ks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(float(a), float(b), i < 500) for i, (a, b) in enumerate(zip(rng.normal(size=1000), rng.exponential(size=1000), strict=True))], "n double, e double, first boolean")
    assert profiling.normality(d, "n").first().normal and not profiling.normality(d, "e").first().normal
    same = profiling.ks(d, "n", F.col("first"), ~F.col("first")).first()
    moved = profiling.ks(d.withColumn("n", F.col("n") + F.when(F.col("first"), 1.0).otherwise(0.0)), "n", F.col("first"), ~F.col("first")).first()
    assert same.pvalue > 0.01 and moved.pvalue < 1e-6


def test_redaction_is_idempotent(spark):
    from pyspark.sql import functions as F

    text = 'token = "abcdef123456" https://u:secret@h.example/x mail a.b@c.example sk-abcdefghijklmnop'
    d = spark.createDataFrame([(text,)], "t string").select(retrieval.redact(F.col("t")).alias("t"))
    once = d.first().t
    assert "abcdef123456" not in once and "secret@" not in once and "@c.example" not in once
    assert d.select(retrieval.redact(F.col("t")).alias("t")).first().t == once


def test_redaction_of_keys_and_long_texts(spark):
    from pyspark.sql import functions as F

    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\nMIIE-x/+=\n-----END RSA PRIVATE KEY-----"
    long = [
        "a@" + "b." * 500_000, "a" * 1_000_000 + "@", "-----BEGIN PRIVATE KEY-----" * 37_000, "x://u:" * 160_000, "token = " * 120_000, "sk-" * 330_000,
        "eyJ" * 330_000, "://a:" + "b" * 1_000_000, "eyJ" + "a." * 500_000, "-" * 1_000_000, "-----BEGIN PRIVATE KEY-----" + "-\n" * 480_000 + "-----END PRIVATE KEY-----",
    ]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([f"a {key} b {key} c", *long])], "i int, t string").repartition(4)
    got = {r.i: r.t for r in d.select("i", retrieval.redact(F.col("t")).alias("t"), retrieval.injection_flag(F.col("t")).alias("f")).collect()}
    assert got[0] == "a [PRIVATE KEY] b [PRIVATE KEY] c"
    assert got[1] == "[EMAIL]." and got[2] == long[1] and got[11] == "[PRIVATE KEY]"


def test_markdown_chunks():
    text = "# A\nintro\n## B\n" + "Sentence one. " * 200 + "\n# C\nend"
    got = retrieval.chunk_markdown(text)
    assert got[0] == ("A", "intro") and got[-1] == ("C", "end") and {c for c, _ in got} == {"A", "A > B", "C"}
    assert max(len(t) for _, t in got) <= 1000


def test_html_text(spark):
    from pyspark.sql import functions as F

    html = "<html><head><title>no</title></head><body><script>x</script><p>a &amp; b</p><!-- c --><style>y</style>d&nbsp;e</body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(retrieval.html_text(F.col("h"))).first()[0] == "a & b d e"


def test_graph_without_edges(spark):
    nodes = spark.createDataFrame([("a", "A", "t", None)], "id string, label string, type string, community string")
    edges = spark.createDataFrame([("a", "a")], "source string, target string")
    assert graphs.hubs(nodes, edges).count() == 0
    kept, left = graphs.prune(nodes, edges.limit(0), drop_isolated=True)
    assert kept.count() == 0 and left.count() == 0
