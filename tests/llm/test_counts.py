"""Near duplicates, mixing and quality rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm import mixing, quality_rules, simhash
from plumbline.llm.graph import components

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance=2):
    """value -> least value reachable."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint():
    for _, text, *_ in data.rows():
        if text is None or len(text) < 5000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_duplicates_on_awkward_rows(spark):
    rows = data.rows()
    got = simhash.near_duplicates(data.table(spark)).collect()
    assert len(got) == len(rows)
    prints = {r[1]: simhash.fingerprint(r[1]) for r in rows}
    comp = slow_components(set(prints.values()))
    least = {}
    for i, t, *_ in rows:
        c = comp[prints[t]]
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = Counter((i, f"{prints[t]:016x}", least[comp[prints[t]]]) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want


def test_one_row_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(data.table(spark))
    assert kept.columns == data.table(spark).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert Counter(ids)[5] == 0 and Counter(ids)[1] == 1 and 9 not in ids and 8 in ids and 2 in ids and 3 not in ids


def test_different_texts_of_one_id_stay(spark):
    """Rows that share an id are told apart by their texts, on every run alike."""
    texts = [(1, data.prose(1, 80)), (1, data.prose(2, 80)), (1, data.prose(2, 80)), (2, data.prose(2, 80)), (3, data.prose(1, 80)), (4, data.prose(3, 80))]
    docs = data.table(spark, [(k, t, "en", "a", 0, *[None] * 10) for k, t in texts])
    for n in (1, 3):
        kept = simhash.drop_near_duplicates(docs.repartition(n))
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([texts[0], texts[1], texts[5]])


def test_links_find_every_pair(spark):
    """Random fingerprints around centres: chains, and a crowd larger than a bucket."""
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:20]:
        for _ in range(4):
            values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    crowd = rng.getrandbits(64)
    values |= {crowd ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    entries = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(entries)).collect()}
    want = slow_components(values)
    groups, expected = defaultdict(set), defaultdict(set)
    for (s,) in signed:
        groups[roots.get(s, s)].add(s)
        expected[want[s % (1 << 64)]].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("costs", [[[0, 1, 9, 99], [0, 5, 6, 7]], [[0, 10, 11, 12]] * 3, [[0, 3, 3, 3], [0, 1, 8, 9], [0, 2, 50, 60], [0, 100, 200, 300]]])
def test_allocation_is_optimal(costs):
    import itertools

    value, chosen = simhash.allocate(costs, 2)
    best = min(sum(c[u] for c, u in zip(costs, pick)) for pick in itertools.product(range(4), repeat=len(costs)) if sum(pick) == 3)
    assert value == best and sum(t + 1 for t in chosen) == 3


def test_empty_tables(spark):
    empty = data.table(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(empty).count() == 0
    assert quality_rules.apply_rules(empty).count() == 0


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        new = {s: 2.0 * sizes[s] for s in names if s not in capped and rest * weight[s] / w > 2.0 * sizes[s]}
        if not new:
            return capped | {s: rest * weight[s] / w for s in names if s not in capped}
        capped |= new


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, data.prose(k, rng.choice([1, 5, 40, 200])), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0, *[None] * 10) for k in range(400)]
    docs = data.table(spark, rows)
    got = mixing.mix(docs).collect()
    size = {k: len(WORD.findall(t)) for k, t, *_ in rows}
    sizes = defaultdict(int)
    for k, _, _, s, *_ in rows:
        sizes[s] += size[k]
    target, taken, source = slow_targets(sizes), defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert target[s] - max(size.values()) <= taken[s] <= target[s] + 1e-6
    assert sorted(got) == sorted(mixing.mix(docs).collect())
    copies = Counter(r["doc_id"] for r in mixing.apply_mix(docs).select("doc_id").collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got)


def test_mix_on_awkward_rows(spark):
    got = mixing.mix(data.table(spark)).collect()
    assert len(got) == len(data.rows()) and all(r["size"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert mixing.apply_mix(data.table(spark)).columns == data.table(spark).columns


def slow_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_rules(spark):
    rows = [(k, t, *r[2:]) for k, r in enumerate(data.rows()) for t in [r[1]]]
    rows += [(100, "same line here\nsame line here\n\n\nsame line here\n", "en", "a", 0, *[None] * 10), (101, ("one two three four five six seven eight " * 3), "en", "a", 0, *[None] * 10), (102, "a|b ### $5 <x> & y", "en", "a", 0, *[None] * 10)]
    texts = {r[0]: r[1] for r in rows}
    got = quality_rules.apply_rules(data.table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow_counts(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want, r
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_adapt(spark):
    """The same share of symbols is usual in one group and odd in another."""
    plain = [(k, data.prose(k, 60), "en", "a", 0, *[None] * 10) for k in range(300)]
    marked = [(1000 + k, data.prose(k, 60).replace(" ", "# "), "en", "b", 0, *[None] * 10) for k in range(300)]
    odd = [(5000, data.prose(9, 60).replace(" ", "# "), "en", "a", 0, *[None] * 10)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(data.table(spark, plain + marked + odd)).collect()}
    assert not kept[5000] and np.mean([kept[r[0]] for r in plain]) > 0.99 and kept[1001]


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1])
def test_planted_junk_sets_no_limit(spark, share):
    """Junk with three symbols a word is over one row in a hundred, and passes the base rule."""
    rng = np.random.default_rng(4)
    plain = [(k, data.prose(k, 60).replace(" ", "# " if k % 50 == 0 else " ", 3), "en", "a", 0, *[None] * 10) for k in range(1000)]
    junk = [(5000 + k, " ".join(f"{w}{''.join(rng.choice(list('#*$%&|<>'), 3))}" for w in data.prose(k, 50).split()), "en", "a", 0, *[None] * 10) for k in range(int(1000 * share))]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(data.table(spark, plain + junk)).collect()}
    assert not any(kept[r[0]] for r in junk) and np.mean([kept[r[0]] for r in plain]) > 0.99
