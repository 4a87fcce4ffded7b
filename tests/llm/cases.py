"""Rows with nulls, ties, repeats, long texts and columns whose names clash with the operators' own."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, digest int, verdict string, row int"


def documents(seed=0, n=160):
    rng = random.Random(seed)
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    vocabulary = [f"w{i}" for i in range(400)] + ["straße", "ÉTÉ", "naïve", "Σίσυφος", "日本", "don't", "x<|endoftext|>y", "²½", "İ"]
    passage = " ".join(rng.choice(vocabulary[:400]) for _ in range(60))
    rows = []

    def add(doc_id, text, lang="en", source="s0"):
        rows.append((doc_id, text, lang, source, len(text or ""), "c", 7, "v", 1))

    for r in base[: n // 2]:
        add(r["doc_id"], r["text"], r["lang"], r["source"])
    for i in range(n // 2):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 34, 35, 36, 70, 200]))]
        text = rng.choice([" ", "  ", "\t", "  "]).join(words)
        if i % 4 == 0:
            text += "\n" + passage + "\n" + words[0]
        if i % 5 == 0:
            text = " ".join(words[:40]) + " " + " ".join(words[:40]) + "\nline\nline\n \nline"
        add(1000 + i, text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "S1", "é", "", None]))
    near = "one two three " + passage + " four five six " + " ".join(vocabulary[:80])
    for i in range(12):
        add(2000 + i, near + (f" end{i}" if i else ""), "en", "s2")
    for text in (None, "", " ", "\n\t", "A", "a", "ABC def", "abc DEF", "É", "é"):
        add(3000 + len(rows), text)
    add(None, "abc def")
    add(None, None)
    add(-5, "negative id " * 30)
    add(1000, "another text under the same id")
    for _ in range(3):
        add(4000, passage)
    add(5000, ("very long " + passage + " ") * 200)
    add(5001, "x" * 100_000)
    add(5002, "<html> # * $ %% &&& | " * 20)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3).select(
        "copies", "text", "doc_id", "lang", "source", "n_chars", "digest", "verdict", "row"
    ).withColumn("a.b", F.lit(1))


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
