import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veldrift.llm import common, exact_dedup, simhash, substring

from .cases import SCHEMA, documents, frame, lower, words


def test_exact_dedup_matches_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = 0
        for i in ids:
            stays = i == keep and not kept
            kept += stays
            expected.append((i, keep, len(ids), stays, sha))
    for digest in (F.xxhash64, lambda k: F.length(k).cast("long")):  # the second one clashes
        got = [tuple(r) for r in exact_dedup.mark_duplicates(frame(spark), digest=digest).collect()]
        assert Counter(got) == Counter(expected)


def test_drop_duplicates_keeps_rows_and_columns(spark):
    df = frame(spark)
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    best = {}
    for r in documents():
        k = lower(r[1])
        best[k] = max(best.get(k, -(2**63)), -(2**63) if r[0] is None else r[0])
    got = Counter((lower(r.text), -(2**63) if r.doc_id is None else r.doc_id) for r in out.collect())
    assert got == Counter(best.items())


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.mark_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def fingerprint(text, n=4):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_simhash_matches_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    seen = {}
    rows = [r for r in rows if seen.setdefault(r[0], r[1]) == r[1]]
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert any(prints[a] != prints[b] for a, b in links)
    group = components(links, ids)
    expected = Counter((r[0], f"{prints[r[0]]:016x}", group[r[0]]) for r in rows)
    for split_over in (2000, 2):
        got = simhash.near_duplicates(frame(spark, rows), split_over=split_over).collect()
        assert Counter(map(tuple, got)) == expected
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_simhash_of_nulls_and_shared_ids(spark):
    out = simhash.near_duplicates(frame(spark)).collect()
    assert len(out) == len(documents())
    assert sum(r.fingerprint == "0" * 16 for r in out) == sum(not words(r[1]) for r in documents())
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark)).collect()
    prints = [fingerprint(r.text) for r in kept]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])


def test_deletion_variants_lose_no_link():
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = []
    for c in center:
        for _ in range(30):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    masks = simhash.variants(4)
    keys = [{(t, p & m) for t, m in masks} for p in prints]
    for i, a in enumerate(prints):
        for j in range(i + 1, len(prints)):
            if (a ^ prints[j]).bit_count() <= 4:
                assert keys[i] & keys[j]


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(-7, -9), (500, 500)]
    out = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == components(edges, {x for e in edges for x in e})


def repeats(rows, n):
    seen = Counter()
    texts = [words(r[1]) for r in rows]
    for t in texts:
        seen.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(t) - n + 1):
            if seen[tuple(t[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(t) if i not in gone)
        out.append((r[0], len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_matches_brute_force(spark):
    rows = documents()
    for group in (2000, 1):
        got = substring.remove_repeats(frame(spark, rows), group=group).drop("kept_words")
        assert Counter(map(tuple, got.collect())) == repeats(rows, 35)
    got = substring.remove_repeats(frame(spark, rows), window=12, prefix=3).drop("kept_words")
    assert Counter(map(tuple, got.collect())) == repeats(rows, 12)
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_do_not_depend_on_place_or_block():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    h[100:140] = h[60:100]
    a = substring.anchors(h, 35, 8)
    b = substring.anchors(h[50:], 35, 8)
    runs = dict(zip((a[0] - 50).tolist(), a[4].tolist(), strict=True))
    same = [x for x, r in zip(b[0].tolist(), b[4].tolist(), strict=True) if runs.get(x) == r]
    assert len(same) >= len(b[0]) - 2
    covered = np.concatenate([np.arange(f, e + 1) for f, e in zip(a[1], a[2], strict=True)])
    assert (covered == np.arange(300 - 34)).all()
