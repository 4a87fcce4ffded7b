import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veldrift.llm import mixing, packing

from .cases import SCHEMA, documents, frame, words


def share(sizes):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        w = sum(weight[s] for s in free)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / w for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        fixed |= set(over)


def test_mixing_meets_targets(spark):
    rows = documents()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = share(dict(sizes))
    out = mixing.copies(frame(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    again = mixing.copies(frame(spark)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in out) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mix_repeats_rows(spark):
    df = frame(spark)
    out = mixing.mix(df)
    assert out.columns == df.columns
    expected = Counter()
    for r in mixing.copies(df).collect():
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +expected
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.copies(df.filter("text is null")).agg({"taken": "sum"}).first()[0] == 0


def test_pack_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    rows = documents()
    t = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[(r[0], k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    out = packing.pack(frame(spark)).collect()
    assert Counter(tuple(r)[:5] for r in out) == expected
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def least_bins(items, capacity):
    """Exact number of bins of a few items."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                k = bins.index(room)
                place(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_valid_and_reduction_is_optimal(items):
    items = sorted(items, reverse=True)
    counts = np.bincount(items, minlength=21)
    left = counts.copy()
    fixed = packing.reduce_counts(left, 20)
    rest = [x for x in range(20, 0, -1) for _ in range(left[x])]
    assert sum(n for _, n in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)
    steps = packing.plan(counts, 20)
    load, placed = defaultdict(list), Counter()
    for s in steps.itertuples():
        for rank in range(s.rank, s.last):
            k = rank - s.rank
            load[s.first_bin + k // s.per_bin].append((s.offset + k % s.per_bin * s.length, s.length))
            placed[s.length] += 1
    assert placed == Counter(items)
    for pieces in load.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("Σς日本'́ﬁ")), max_size=60))
def test_piece_table_equals_the_tokenizer(text):
    table = piece_table()
    expected = np.array(table.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert table.encode(text) == expected


@functools.cache
def piece_table():
    return packing.PieceTable(packing.tokenizer_path())
