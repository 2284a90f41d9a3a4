"""The pipeline's near copies against all pairs."""

import random

import corpus_pipeline
from plumbline.llm import near_copies, simhash

from . import data


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def edited(rng, text, swaps):
    out = list(text)
    for at in rng.sample(range(len(out)), swaps):
        out[at] = f"x{rng.randrange(100_000)}"
    return out


def jaccard(a, b):
    sets = [{" ".join(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute(texts):
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(k) for k in range(len(texts))]


def test_copies_of_similarity_from_0_8_go(spark):
    rng = random.Random(5)
    texts = []
    for n in (60, 300, 1000):
        for share in (0.004, 0.01, 0.018, 0.03, 0.06):
            first = words(rng, n)
            texts += [" ".join(first), *(" ".join(edited(rng, first, max(1, round(share * n)))) for _ in range(2))]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(texts)
    assert 0 < sum(k != r for k, r in enumerate(want)) < 30
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == dict(enumerate(want))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in enumerate(want) if k == r}


def test_large_buckets_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRED", 8)
    rng = random.Random(6)
    start, texts = words(rng, 120), []
    for _ in range(12):  # groups that share buckets, but are less than 0.8 alike
        middle = start[:100] + words(rng, 20)
        texts += [" ".join([*middle, f"end{k}"]) for k in range(5)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(brute(texts))) and len(set(got.values())) == 12


def test_awkward_rows(spark):
    table = data.table(spark)
    got = near_copies.near_copies(table).collect()
    assert len(got) == table.count()
    assert all(r["component_id"] is None or r["doc_id"] is None or r["component_id"] <= r["doc_id"] for r in got)
    kept = near_copies.drop_near_copies(table)
    assert kept.columns == table.columns and kept.filter("doc_id IS NULL").count() == 2
    ids = [r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 8} <= set(ids) and not {3, 4, 5, 9} & set(ids)
    assert near_copies.drop_near_copies(data.table(spark, [])).count() == 0


def test_fingerprints_link_in_the_pipeline(spark):
    """Repeating a text's middle changes its set of shingles, but hardly their counts by bit; a third text is 0.8 like the second only."""
    first = " ".join(["a b c d e f g h i j"] * 30)
    second = f"{first} " + " ".join(f"w{k}" for k in range(12))
    third = f"{second} end"
    rows = [(5, first), (3, second), (4, third), (6, " ".join(f"x{k}" for k in range(40)))]
    assert jaccard(first, second) < 0.8 <= jaccard(second, third)
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.DISTANCE
    docs = spark.createDataFrame([*rows, (7, None), (8, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {3, 6, 7}
