"""Chunkers, text sources, papers and reports against hand-computed results."""

import pytest

from veldrift.operators import retrieval
from veldrift.sources import files

CODE = '''import os

X = 1
class A:
    y = 2

    def one(self):
        return 1

    async def two(self):
        return 2

def alone():
    return 3
'''


def test_python_is_cut_at_definitions_with_the_class_of_methods():
    got = retrieval.chunk_python(CODE)
    assert [(c, t.split("\n")[0]) for c, t in got] == [("", "import os"), ("", "class A:"), ("A", "def one(self):"), ("A", "async def two(self):"), ("", "def alone():")]
    assert got[1][1] == "class A:\n    y = 2"


def test_long_texts_are_cut_at_lines_with_overlap():
    lines = [f"line {i} " + "x" * 40 for i in range(60)]
    pieces = retrieval.cut_lines("\n".join(lines), cap=300, overlap=100)
    assert all(len(p) <= 300 for p in pieces) and {x for p in pieces for x in p.split("\n")} == {x.strip() for x in lines}
    assert all(a.split("\n")[-2:] == b.split("\n")[:2] for a, b in zip(pieces, pieces[1:], strict=False))
    assert retrieval.cut_lines("y" * 700, cap=300, overlap=100) == ["y" * 300, "y" * 300, "y" * 300, "y" * 100]


def test_sentences_are_the_last_resort():
    text = " ".join(f"Sentence number {i} is here." for i in range(50))
    got = [t for _, t in retrieval.chunk_sentences(text, cap=200)]
    assert text.startswith(" ".join(got)) and len(text) - len(" ".join(got)) <= 100 and all(len(t) <= 200 for t in got)  # a short end goes
    assert retrieval.chunk_sentences("Short.") == [("", "Short.")] and retrieval.chunk_file("a.txt", "") == []


def test_files_are_cut_by_their_ending(spark):
    rows = [("a.py", CODE), ("b.md", "# T\nintro\n## U\nbody"), ("c.txt", "One. Two."), ("d.py", None)]
    got = retrieval.chunk_files(spark.createDataFrame(rows, "source string, text string")).collect()
    assert [(r.source, r.section) for r in sorted(got, key=lambda r: (r.source, r.chunk_no))] == [("a.py", ""), ("a.py", ""), ("a.py", "A"), ("a.py", "A"), ("a.py", ""), ("b.md", "T"), ("b.md", "T > U"), ("c.txt", "")]


def test_text_sources_take_the_first_row_that_names_a_file(spark, tmp_path):
    for name, text in (("docs/a.md", "a"), ("docs/b.txt", "b"), ("docs/sub/c.md", "c"), ("code/d.py", "d"), ("code/build/e.py", "e")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    table = [("code", "*.py", True, None), ("docs", "*.*", False, (".md", ".rst")), ("docs", "*.md", True, None), ("absent", "*", True, None)]
    got = {(r.source, r.text) for r in files.text_sources(spark, str(tmp_path), table, excluded=("/build/",)).collect()}
    assert got == {("code/d.py", "d"), ("docs/a.md", "a"), ("docs/sub/c.md", "c")}
    assert files.text_sources(spark, str(tmp_path), []).count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.csv").write_text("12345")
    assert [tuple(r) for r in files.datasets(spark, str(tmp_path)).collect()] == [("raw", "x.csv", 5)]


def test_atom_feeds_become_papers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("""<feed><entry><id> http://p/1 </id><title> A title </title><summary>Text.</summary><published>2021-03-04T00:00:00Z</published>
      <author><name>Ann</name></author><author><name>Bo</name></author></entry><entry><id>u</id><published>soon</published></entry></feed>""")
    got = {r.url: r for r in files.read_atom(spark, str(tmp_path / "feed.xml")).collect()}
    assert (got["http://p/1"].title, got["http://p/1"].authors, got["http://p/1"].year) == ("A title", ["Ann", "Bo"], 2021)
    assert (got["u"].title, got["u"].authors, got["u"].year, got["u"].doi) == ("", [], None, None)


def test_reports_are_whole_or_refused(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    files.write_report(d, str(tmp_path), "Title")
    assert (tmp_path / "report.md").read_text().splitlines() == ["# Title", "", "| name | value |", "|---|---|", "| a | 1.5000 |", "| b |  |"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "report.csv")).count() == 2
    with pytest.raises(ValueError):
        files.markdown(spark.range(5).toDF("x"), rows=4)


def test_tables_and_their_schemas(spark):
    spark.range(1).createOrReplaceTempView("chunk_test_view")
    assert "chunk_test_view" in [r.name for r in files.list_tables(spark).collect()]
    assert [tuple(r) for r in files.table_schema(spark, "chunk_test_view").collect()] == [("id", "bigint")]
    with pytest.raises(ValueError):
        files.table_schema(spark, "x; drop table y")
