"""Prefix trie: nodes by plain Python, ranges that cut paths, large ends, awkward turns."""

import hashlib
import random
from collections import defaultdict

import pytest

from plumbline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, seq string, depth long"


def table(spark, turns):
    return spark.createDataFrame([(*t, "k", 7, "s", 7) for t in turns], SCHEMA)


def slow_conversations(turns):
    out = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in out.items()}


def slow_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(m) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def drawn(seed, n=300, letters="ab"):
    """Conversations that share long beginnings, end within one another, and repeat; one of them 300 times."""
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        out[c * 3 - 50] = [("user", rng.choice(letters) * (1 + k % 3)) for k in range(rng.randint(0, 9))]
    out |= {5000 + c: [("user", "a")] * 6 for c in range(300)} | {9001: [("user", "a")] * 200, 9002: [("user", "a")] * 150 + [("user", "b")]}
    return out


def rows_of(spark, convs):
    """Turns by way of the table, and conversations without turns beside it."""
    turns = [(c, k, r, t) for c, v in convs.items() for k, (r, t) in enumerate(v)]
    made = prefix_trie.conversations(table(spark, turns))
    empty = spark.createDataFrame([(c,) for c, v in convs.items() if not v] or [(0,)], "conv_id long")
    none = empty.join(made.select("turns").limit(1)).selectExpr("conv_id", "slice(turns, 1, 0) AS turns")
    return made.unionByName(none) if any(not v for v in convs.values()) else made


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes_across_ranges(spark, many_ranges, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    convs = drawn(seed)
    got = [tuple(r) for r in prefix_trie.trie(rows_of(spark, convs)).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_trie(convs)


def test_nodes_in_one_range(spark):
    convs = drawn(4, letters="abc")
    assert {tuple(r) for r in prefix_trie.trie(rows_of(spark, convs)).collect()} == slow_trie(convs)


def test_compressed_points_only(spark):
    """A path without branches has one point below the root; its unary nodes come from the edge."""
    path = prefix_trie._Path(0, 0)
    path.add(b"".join(bytes([k]) * 16 for k in range(50)), [1] * 50, 7, 3, "e")
    assert len(path.points) == 2
    path.end()
    assert [(r[4], r[1], r[7], r[11] - r[12] + 2 * r[10]) for r in path.rows[:-1]] == [(d, d == 50, 3, 2 * (51 - d)) for d in range(50, 0, -1)]


def test_awkward_turns(spark):
    turns = [(1, None, "user", "first"), (1, 0, None, "x"), (1, 0, None, "x"), (1, 1, "user", None), (2, 0, "user", ""), (2, 1, "user", ""), (None, 0, "user", "lost"), (-3, 0, "user", "y" * 50_000), (-3, 2, "", "😀é")]
    turns += [(4, 0, "a", "b:c"), (5, 0, "a:b", "c"), (6, 0, "ab", "c"), (7, 0, "a", "bc"), (8, 3, "user", "first"), (8, 3, "assistant", "x")]
    got = {tuple(r) for r in prefix_trie.trie(prefix_trie.conversations(table(spark, turns))).collect()}
    assert got == slow_trie(slow_conversations(turns))


def test_rebuilt_beginnings(spark):
    import zlib

    convs = {c: [("user", f"{c}-{k}") for k in range(n)] for c, n in [(100, 3), (101, 8), (150, 1), (199, 5), (202, 2), (250, 1), (-100, 2), (-1, 4), (0, 7), (3, 1)]}
    want = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + v[h:]
    got = prefix_trie.trie(prefix_trie.shared_beginnings(rows_of(spark, convs)))
    assert {tuple(r) for r in got.collect()} == slow_trie(want)


def test_empty_table(spark):
    assert prefix_trie.trie(prefix_trie.conversations(table(spark, []))).collect() == []
