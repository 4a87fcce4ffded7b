"""The pipeline's near-copy stage against brute-force Jaccard."""

import random

import corpus_pipeline

from veldrift.llm import near, simhash
from veldrift.llm.common import connected_components

from .cases import frame, lower, words


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def texts_around_the_limit():
    """Groups of variants whose similarities spread around 0.8, and one long common passage in other texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for size in (2, 3, 5, 80):
        base = [word() for _ in range(150)]
        for _ in range(size):
            new = list(base)
            for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
                new[at] = word()
            out.append(" ".join(new))
    passage = [word() for _ in range(100)]
    out += [" ".join([*passage, *(word() for _ in range(60))]) for _ in range(80)]
    return out


def components_of(texts):
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_links_span_all_pairs_of_brute_force(spark):
    texts = texts_around_the_limit()
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    # Small buckets; crowded ones dealt into blocks at once; by a second band and then into blocks.
    for crowded, hashes, levels in ((2048, 2_000_000, 3), (20, 3000, 1), (3, 2_000_000, 2)):
        got = {r.node: r.component for r in connected_components(near.links(rows, crowded=crowded, hashes=hashes, levels=levels)).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == components_of(texts)


def test_empty_table_and_rows_without_text(spark):
    none = spark.createDataFrame([], "row long, text string")
    assert near.links(none).collect() == []
    assert near.drop_near_copies(frame(spark, [])).collect() == []
    rows = [(i, t, "en", "s", 0, "c", 1, "v", 1) for i, t in enumerate([None, "", " ", None, "one two", "One  two", "three"])]
    assert sorted(r.doc_id for r in near.drop_near_copies(frame(spark, rows)).collect()) == [0, 4, 6]


def test_stage_keeps_one_of_each_group_at_the_limit(spark):
    texts = texts_around_the_limit()
    rows = [(i, t, "en", "s", 0, "c", 1, "v", 1) for i, t in enumerate(texts)]
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components_of(texts)))


def test_null_and_shared_ids_join_no_groups(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(None if i < 8 else 7, t, "en", "s", 0, "c", 1, "v", 1) for i, t in enumerate([*texts, texts[0]])]
    for drop in (near.drop_near_copies, simhash.drop_near_duplicates):
        kept = drop(frame(spark, rows)).collect()
        assert sorted(r.text for r in kept) == sorted(texts)
        assert sorted((r.doc_id for r in kept), key=str) == [7] * 5 + [None] * 7


def test_fingerprints_link_copies_and_near_ones(spark):
    """SimHash alone links the closest texts, and only those."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:-1], "new"]), *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(10)), "a b", "c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    got = {r.node: r.component for r in connected_components(near.links(rows, levels=0)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == components_of(texts) and max(got) == 2
