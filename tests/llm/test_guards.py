"""What operators refuse, and what they do with files and rows that they were not made for."""

import json

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veldrift.llm import exact_dedup, mixing, packing, substring

from .cases import documents, frame


def test_windows_have_a_limit(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(frame(spark), window=300)


def test_another_tokenizer_gets_whole_texts(tmp_path):
    spec = json.load(open(packing.tokenizer_path(), encoding="utf-8"))
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    for file, known in ((packing.tokenizer_path(), True), (str(path), False)):
        table, whole = packing.PieceTable(file), Tokenizer.from_file(file)
        assert table.known == known
        for text in ("Some  Words, AND more's 12", "É à la ²", "", " \n"):
            ids = whole.encode(text, add_special_tokens=False).ids
            assert table.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_repeated_rows_with_maps(spark):
    some = documents()[:20]
    d = frame(spark, some * 2).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    kept = exact_dedup.drop_duplicates(d)
    assert kept.columns == d.columns and kept.count() == exact_dedup.drop_duplicates(frame(spark, some)).count()
    assert mixing.mix(d).columns == d.columns
