"""Spelling variants: every pair by brute force, large buckets, awkward rows, the query's SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from plumbline.llm import queries, spelling

from . import data

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def slow_words(docs, least_length=5, least_count=3, every=0):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    return {w: c for w, c in n.items() if c >= least_count}


def slow_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("most", [2, 30, 10_000])
def test_all_pairs_of_crowded_words(spark, most):
    """Two letters and short lengths: nearly all words share segments, down to one open place."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab" if k % 3 else "abé") for _ in range(rng.randint(1, 7))) for k in range(400)} | {"x" * 40 + c for c in "abcdefg"} | {"x" * 39, "ß", "ab" * 3000, "ab" * 3000 + "c"})
    counted = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r["a"], r["b"]) for r in spelling.near_words(counted, most).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_no_bucket_is_joined_whole(spark):
    """300 words share both their halves with others; no level joins more than the limit's pairs of a bucket."""
    words = [f"{a}{b}" for a in ("prefix", "suffix", "middle") for b in (f"{k:06d}" for k in range(100))]
    counted = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = spelling.near_words(counted, 16).count()
    assert got == sum(one_edit(a, b) for i, a in enumerate(words) for b in words[:i])


def test_awkward_rows(spark):
    rows = data.rows()
    rows += [(k, "Garden gardan GARDEN gardenn yellow", "en", "a", 35, 7, 7, 7, ["w"], 7, 7, 7, True, 7, "v") for k in (30, 31, 32, 32, None)]
    docs = data.table(spark, rows).withColumnRenamed("value", "word")
    for every in (0, 2):
        got = {tuple(r) for r in spelling.variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()}
        assert got == slow_variants(slow_words([(r[0], r[1]) for r in rows], every=every))


def test_chains_end_at_their_root(spark):
    docs = spark.createDataFrame([(1, "aaaaab " * 2 + "aaaabb " * 4 + "aaabbb " * 8 + "aabbbb " * 16 + "abbbbb " * 32)], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in spelling.variants(docs, least_count=2).collect()}
    assert got == dict.fromkeys(["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"], "abbbbb")


def test_empty_table(spark):
    assert spelling.variants(data.table(spark, [])).collect() == []
    assert spelling.variants(data.table(spark, [(None, None) + data.rows()[0][2:]])).collect() == []


def test_counts_are_handed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = data.rows()
    got = {(r["word"], r["n"]) for r in spelling.words(data.table(spark, rows)).collect()}
    assert got == set(slow_words([(r[0], r[1]) for r in rows]).items())


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_prefix_trie", "op11_url_filter"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert rows and sorted(rows, key=str) == sorted(want.fetchall(), key=str)
