"""Hard negatives against scoring all rows: many lists, ties, a common vector, odd rows, empty tables."""

import math
import random

import numpy as np
import pytest

from veldrift.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, list int, rank string"


def brute(rows, every=100):
    good = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 4096 for x in v)
    ]
    lengths = [len(v) for *_, v in good]
    dim = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if good else 0
    good = [r for r in good if len(r[2]) == dim]
    anchors = {}
    for i, label, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, of) for i, of, w in good if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(fits, 1)]
    return sorted(out)


def table(seed=0, n=900, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    rows = []
    for i in range(n):
        v = centres[i % 7] + rng.normal(size=dim) * 0.3
        rows.append((i, (np.round(v, 1) if i % 3 else v).tolist(), int(rng.integers(0, 4)), 1, "r"))
    rows += [(5000 + i, [0.5] * dim, i % 2, 1, "r") for i in range(120)]  # a common vector
    rows += [(700, [0.0] * dim, 1, 1, "r"), (700, [0.1] * dim, 0, 1, "r"), (11, rows[11][1], rows[11][2], 1, "r"), (-100, [1.0] * dim, 2, 1, "r")]
    odd = [(None, [0.1] * dim, 1), (6000, None, 1), (6100, [0.1] * dim, None), (6200, [0.1] * (dim - 1) + [None], 1), (6300, [math.nan] * dim, 1), (6400, [math.inf] * dim, 1), (6500, [1e9] * dim, 1), (6600, [0.3] * 3, 1), (6700, [], 1)]
    rows += [(*r, 1, "r") for r in odd]
    random.Random(seed).shuffle(rows)
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("list_rows, part_bytes, block", [(25, 1 << 20, 256), (5000, 600, 2), (10, 300, 3)])
def test_equals_scoring_all_rows(spark, monkeypatch, list_rows, part_bytes, block):
    """Many lists and several rounds; one list of many parts; small blocks of queries."""
    monkeypatch.setattr(negatives, "PART_BYTES", part_bytes)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("rank", "label", "embedding", "list", "vec_id")
    assert got(negatives.hard_negatives(df, every=20, list_rows=list_rows)) == brute(rows, 20)


def test_lists_are_skipped(spark):
    """Groups far apart: a query near one of them visits few lists, and the result stays whole."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.02).tolist(), i % 3, 1, "r") for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, dim = negatives.vectors(df)
    lists = negatives.build(whole, dim, list_rows=50)
    index = lists.index.value
    assert index["sizes"].sum() == 1600 and len(index["sizes"]) > 8
    x = np.floor(np.array([r[1] for r in rows]) * 256)
    near = negatives.nearest(x, index["c"])
    assert (np.sqrt(((x - index["c"][near]) ** 2).sum(axis=1)) <= index["radius"][near] + 1e-9).all()
    assert got(negatives.hard_negatives(df, list_rows=50)) == brute(rows)
    norm = np.sqrt((x[0] ** 2).sum())
    upper = index["c"] @ x[0] + norm * index["radius"]
    fifth = np.sort(x @ x[0])[-6]
    assert (upper < fifth).mean() > 0.5  # more than half of the lists need no visit


def test_empty_table_and_few_rows(spark):
    assert got(negatives.hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    rows = [(0, [1.0, 0.0], 1, 1, "r"), (1, [1.0, 0.0], 1, 1, "r"), (2, [0.9, 0.0], 2, 1, "r"), (3, [0.0, 0.0], 2, 1, "r")]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(0, 1, 1, 2, 65536, 58880)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows[:1], SCHEMA))) == []
