"""What a task holds at a time doesn't depend on the numbers of queries, vectors and models."""

import re

import numpy as np
import pandas as pd

from plumbline.operators import knn, quantizers

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def rows(block, asks, ids, x):
    return pd.DataFrame({"block": block, "asks": asks, "id": ids, "vector": list(x)})


def test_pairs_measured_at_a_time():
    rng = np.random.default_rng(1)
    x, sizes = rng.standard_normal((8192, 4)), []

    def distances(q, base):
        sizes.append(len(q) * len(base))
        return knn.rough_squared_distances(q, base)

    given = [rows(0, 0, np.arange(8192), x), rows(0, 1, np.arange(300), x[:300])]
    got = pd.concat(knn._best(3, ["q", "b", "d"], distances)(iter(given)))
    assert max(sizes) <= 1 << 19  # 256 queries met all 8192 vectors before
    assert len(got) == 900 and (got.groupby("q")["b"].first().to_numpy() == np.arange(300)).all()


def test_codes_are_searched_by_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, k = 700, 9
    codes, book, asked = rng.integers(0, 3, (n, 4)), rng.standard_normal((4, 3, 2)), rng.standard_normal((40, 8))
    coded = spark.createDataFrame([(i, m, int(codes[i, m])) for i in range(n) for m in range(4)], "base_id long, m long, c long")
    books = spark.createDataFrame([(m, c, book[m, c].tolist()) for m in range(4) for c in range(3)], "m long, c long, centroid array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, qe array<double>")
    calls, search = [], knn.blocked_top_k
    monkeypatch.setattr(quantizers, "blocked_top_k", lambda *a: calls.append(a[5:]) or search(*a))
    want = []
    for i, q in enumerate(asked):
        d = np.zeros(n)
        for m in range(4):
            lut = np.zeros(3)
            for j in range(2):
                lut += (q[2 * m + j] - book[m, :, j]) ** 2
            d += lut[codes[:, m]]
        want += [(i, int(b), d[b], r + 1) for r, b in enumerate(np.lexsort((np.arange(n), d))[:k])]
    for block, tasks in ((32_768, 48), (300, 7)):  # one task, and several that share blocks
        monkeypatch.setattr(quantizers, "CODED", block, raising=False)
        monkeypatch.setattr(quantizers, "TASKS", tasks, raising=False)
        monkeypatch.setattr(quantizers, "BLOCK", 100, raising=False)
        got = quantizers.adc_top_k(queries, coded, books, k).select("query_id", "base_id", "adc", "rk").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert calls == [(32_768, 7), (300, 2)]  # 8192 vectors a block before, each of which sent k rows a query


def test_batches_of_models_are_small(spark):
    models = [quantizers.Model("a", 2), quantizers.Model("b", 4, turn=1), quantizers.Model("c", 2, turn=1)]
    x = np.random.default_rng(3).standard_normal((5000, 4))
    books = {m.name: x[:12].reshape(12, m.parts, -1).transpose(1, 0, 2) for m in models}
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "base_id long, be array<double>").coalesce(1)
    spark.conf.set(KEY, str(64 << 20))
    coded = quantizers.encode_models(base, models, books)
    assert int(spark.conf.get(KEY)) <= 2 << 20
    got = {(r["base_id"], r["model"]): r["codes"] for r in coded.collect()}
    assert len(got) == 15_000
    for i in (0, 2047, 2048, 4999):
        for m in models:
            own = quantizers.turned(x[i : i + 1], m.turn).reshape(m.parts, -1)
            assert got[i, m.name] == [int(((books[m.name][p] - own[p]) ** 2).sum(axis=1).argmin()) for p in range(m.parts)]
    spark.conf.set(KEY, str(64 << 20))
    pool = spark.createDataFrame([(0, 0, 5, 1.0)], "query_id long, pos long, base_id long, adc double")
    queries = base.filter("base_id = 0").toDF("query_id", "qe")
    scored = quantizers.score_pool(pool, queries, base, coded, models, books)
    assert int(spark.conf.get(KEY)) <= 2 << 20
    assert {r["model"] for r in scored.collect()} == {"a", "b", "c"}


def test_blocks_are_searched_by_tiles():
    """Single precision chooses from tiles, exact sums rank; where it can't tell vectors apart, double precision chooses as before."""
    rng, k = np.random.default_rng(4), 9
    plain = rng.standard_normal((5000, 16))
    for base, single in ((plain, True), (plain[rng.integers(0, 300, 5000)], True), (np.round(plain), None), (plain + 1e4, False), (plain[:5], False)):
        asked, ids = base[:: max(1, len(base) // 100)] + 0.0, rng.permutation(len(base))
        d = np.zeros((len(asked), len(base)))
        for j in range(16):
            d += (asked[:, j, None] - base[None, :, j]) ** 2
        want = [(q, ids[b], d[q, b]) for q in range(len(asked)) for b in np.lexsort((ids, d[q]))[:k]]
        block = knn._Block(ids, base)
        assert single is None or (block._roughly(k, asked) is not None) == single
        assert [row for rows in block.nearest(k, np.arange(len(asked)), asked) for row in zip(*rows, strict=True)] == want


def test_tasks_share_blocks_by_queries_and_base(spark, monkeypatch):
    """A base that asks for itself sends either side to a few tasks only; each query met a block of 8192 vectors a task before."""
    monkeypatch.setattr(knn, "WORTH", 20)
    x = np.random.default_rng(5).standard_normal((400, 4))
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    for queries in (base, base.filter("id % 40 = 0")):
        found = knn.blocked_top_k(queries, base, 3, ("q", "b", "d"))
        laid = [int(n) for n in re.findall(r"RepartitionByExpression .*?, (\d+)", found._jdf.queryExecution().optimizedPlan().toString())]
        assert len(laid) == 1 and 12 <= laid[0] <= 60
        got = sorted((r["q"], r["rk"], r["b"]) for r in found.collect())
        want = [(q, r + 1, int(b)) for q in range(0, 400, 400 // queries.count()) for r, b in enumerate(((x - x[q]) ** 2).sum(axis=1).argsort(kind="stable")[:3])]
        assert got == want
