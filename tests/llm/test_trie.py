"""The prefix trie against brute force: rebuilt heads, colliding fingerprints, long conversations, odd rows, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldrift.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp int"


def table(seed=0, convs=60):
    rng = random.Random(seed)
    rows = []
    openings = [[("user", f"o{k}{i}") for i in range(9)] for k in range(3)]
    for c in range(convs):
        if c % 10 == 5:
            continue  # a base that is absent
        turns = list(rng.choice(openings)[: rng.randint(1, 9)]) + [(rng.choice(["user", "assistant", None, ""]), rng.choice(["x", "é", "日本", "", None, "yes"])) for _ in range(rng.randint(0, 4))]
        rows += [(c, i if i else None, r, t, "d", 1) for i, (r, t) in enumerate(turns)]
    rows += [(101, 0, "user", "the only turn", "d", 1), (-7, 3, "user", "o00", "d", 1), (-5, 3, "user", "o00", "d", 1), (None, 1, "user", "no conversation", "d", 1)]
    rows += [(102, 1, "user", "tie", "d", 1)] * 2 + [(102, 1, "assistant", "tie", "d", 1), (102, 1, None, None, "d", 1)]
    rows += [(103, k, "user", "long " * 3000 if k == 3 else f"o0{k}", "d", 1) for k in range(30)]
    return rows


def in_order(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        base = c - int(abs(c) % 5 * (1 if c > 0 else -1))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bits, size", [(62, 4096), (7, 4096), (62, 3)])
def test_equals_brute_force(spark, bits, size):
    """With 7 bits most groups collide; chunks of 3 turns stand for conversations of many chunks."""
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("fp", "text", "turn", "conv_id", "depth", "role")
    turns = trie.ordered(df)
    paths, ids = trie.share_heads(turns)
    assert got(trie.node_rows(trie.prefix_trie(paths, ids, turns, bits=bits, rounds=40, size=size))) == brute(rebuilt(in_order(rows)))


def test_conversations_as_they_are(spark):
    rows = table(1, 25)
    turns = trie.ordered(spark.createDataFrame(rows, SCHEMA))
    found = trie.prefix_trie(*trie.sequences(turns), turns)
    assert got(trie.node_rows(found)) == brute(in_order(rows))
    texts = found.nodes.filter("depth = 30").join(found.turns, "turn_id").select("role", "text").collect()
    assert [tuple(r) for r in texts] == [("user", "o029")]


def test_a_conversation_over_several_ranges(spark):
    rows = [(1, k, "user", f"t{k % 7}", "d", 1) for k in range(4000)] + [(6, k, "user", f"t{k % 7}", "d", 1) for k in range(4100)] + [(2, 0, "user", "t0", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    turns = trie.ordered(df)
    assert turns.join(df, ["conv_id", "text"]).count() > 0
    assert turns.groupBy("conv_id").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).orderBy("conv_id").collect() == [(1, 1, 4000, 4000), (2, 1, 1, 1), (6, 1, 4100, 4100)]
    nodes = trie.node_rows(trie.prefix_trie(*trie.sequences(turns), turns))
    assert sorted(tuple(r) for r in nodes.filter("depth in (0, 1, 4000, 4001, 4100)").drop("ends_sha256", "saved_tokens").collect()) == [
        (1, 0, None, 3, 1, 1), (1, 1, 1, 3, 1, 1), (1, 4000, 1, 2, 1, 1), (6, 4001, 1, 1, 1, 1), (6, 4100, 6, 1, 0, 1),
    ]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    turns = trie.ordered(empty)
    assert trie.node_rows(trie.prefix_trie(*trie.share_heads(turns), turns)).collect() == []
    assert "op13_prefix_trie" in queries.queries()
