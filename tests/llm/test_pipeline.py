"""The corpus pipeline, stage by stage, against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import pytest

from veldrift.llm.common import stored

from .cases import frame, lower
from .test_near import components_of
from .test_text_rules import statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = stored(frame(spark), "docs")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_all_but_the_last_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_quality_drops_what_the_limits_reject(steps):
    kept = Counter(r.text for r in steps[1].collect())
    for text in {r.text for r in steps[0].collect()}:
        n, _, _, _, repeats = statistics(text)
        if n < 20 or 100 * repeats > 30 * n:
            assert text not in kept
    assert sum(kept.values()) > 10


def test_exact_dedup_leaves_one_of_each_text(steps):
    before, after = {lower(r.text) for r in steps[1].collect()}, [lower(r.text) for r in steps[2].collect()]
    assert Counter(after) == Counter(before)


def test_near_dedup_leaves_one_of_each_group(steps):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in steps[2].collect()), key=lambda r: r[:2])
    group = components_of([r[2] for r in rows])  # each row's first row that it reaches
    expected = [rows[k][:2] for k in sorted(set(group))]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in steps[3].collect()) == expected
    assert len(expected) < len(rows)


def test_mix_only_repeats_rows(steps):
    before, after = Counter(tuple(r) for r in steps[3].collect()), Counter(tuple(r) for r in steps[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert Counter(map(tuple, corpus_pipeline.mix_sources(steps[3].sparkSession, steps[3], SF).collect())) == after


def test_packing_holds_every_document(steps):
    docs = Counter(r.doc_id for r in steps[4].collect())
    pieces = steps[5].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == docs
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_run_equals_its_stages(spark):
    a = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert a == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
