"""Vector and array files, candidate records, the service path, walks over a graph, whole-table ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import storage
from plumbline.operators import graph, knn, quantizers
from plumbline.plans.core import over
from plumbline.sources import records, xvecs
from plumbline.streaming import refinement


def vectors(spark, n, dims=6, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")


def test_vector_files_by_tasks(spark, tmp_path):
    x, base = vectors(spark, 100)
    folder = f"file://{tmp_path}/v"
    assert xvecs.write_xvecs(base, "base_id", "be", folder) == 100
    got = {r["vec_id"]: r["embedding"] for r in xvecs.read_xvecs(spark, folder).collect()}
    assert sorted(got) == list(range(100)) and all(np.allclose(got[k], x[k].astype("f4")) for k in got)
    with pytest.raises(ValueError):
        xvecs.write_xvecs(base, "base_id", "be", folder)
    with pytest.raises(ValueError, match="finite"):
        xvecs.unpack(xvecs.pack(np.array([[1.0, np.inf]])), 2)


def test_raw_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(k, [k, 255 - k]) for k in range(50)], "k long, row array<long>")
    for kind in xvecs.RAW:
        folder = f"file://{tmp_path}/{kind}"
        xvecs.write_raw(rows, "k", "row", folder, kind)
        got = sorted((r["pos"], [int(v) for v in r["row"]]) for r in xvecs.read_raw(spark, folder, kind, 2, rows=50).collect())
        assert got == [(k, [k, 255 - k]) for k in range(50)]
        with pytest.raises(ValueError):
            xvecs.read_raw(spark, folder, kind, 2, rows=51)
    too_large = spark.createDataFrame([(0, [300])], "k long, row array<long>")
    with pytest.raises(Exception, match="out of the range"):
        xvecs.write_raw(too_large, "k", "row", f"file://{tmp_path}/large", "u8")


def test_packed_records(spark, tmp_path):
    pool = spark.createDataFrame([(q, p, 100 * q + p, p / 4, p / 2) for q in range(9) for p in range(q)], "query_id long, pos long, base_id long, exact double, score double")
    folder = f"file://{tmp_path}/packed"
    index = records.pack_candidates(pool, folder)
    assert {(r["query_id"], r["candidate_count"]) for r in index.collect()} == {(q, q) for q in range(1, 9)}
    assert sorted(map(tuple, records.scan_candidates(index, folder).collect())) == sorted(map(tuple, pool.collect()))


@pytest.mark.parametrize("size", [5, 11, 12, 40])
def test_batches_answer_like_single_queries(size):
    rng, worker, out = np.random.default_rng(size), refinement.Worker(0.4, batch=8), []
    asked = {}
    for q in range(30):
        exact, score = rng.integers(0, 9, size) / 4, rng.integers(0, 9, size) / 4  # many ties
        asked[q] = (exact, score)
        out += worker.take(q, np.arange(size) + 1000, exact, score)
    out += worker.answer()
    assert all(r[5] for r in out) and sorted({r[0] for r in out}) == list(range(30)) and {r[1] for r in out} == {0, 1, 2, 3}
    for q, (exact, score) in asked.items():
        places, refined = refinement.refine_one(exact, score, 0.4)
        assert [(r[3] - 1000, r[4]) for r in sorted(out, key=lambda r: r[2]) if r[0] == q] == [(p, refined) for p in places]


def slow_walk(d, near, q, limit, width, first):
    """A beam that expands all open ones of its best at a time, and ends when none is open."""
    seen, done, rounds = {k for k in first if k != q}, set(), 0
    while rounds < limit:
        opened = [k for k in sorted(seen, key=lambda k: (d[k], k))[:width] if k not in done]
        if not opened:
            break
        rounds += 1
        done |= set(opened)
        seen |= {k for b in opened for k in near[b] if k != q}
    return seen, rounds


@pytest.mark.parametrize("limit", [2, 50])
def test_walk(spark, limit):
    import hashlib

    x, base = vectors(spark, 200, 8)
    queries = base.filter("base_id % 20 = 0").select(F.col("base_id").alias("query_id"), F.col("be").alias("qe"))
    edges = graph.knn_graph(base, 6)
    near = {}
    for r in edges.collect():
        if r["rk"] <= 4:
            near.setdefault(r["src"], []).append(r["dst"])
    models = [quantizers.Model("pq4", 4), quantizers.Model("turned", 2, turn=3)]
    books = quantizers.books_of(quantizers.train_models(base, models, 4, 8, 3))
    coded, luts = quantizers.encode_models(base, models, books), quantizers.lookup_tables(queries, models, books)
    codes = {(r["base_id"], r["model"]): r["codes"] for r in coded.collect()}
    first = sorted(range(200), key=lambda k: (hashlib.md5(f"13:{k}".encode()).hexdigest(), k))[:3]
    got, dist = {}, {}
    for r in graph.walk(queries, base, edges, coded, luts, ["exact", "pq4", "turned"], limit, 5, 4, 3).collect():
        got.setdefault((r["query_id"], r["model"]), []).append(r["base_id"])
        dist[r["query_id"], r["model"], r["base_id"]] = r["dist"]
        assert r["exact"] == pytest.approx(((x[r["base_id"]] - x[r["query_id"]]) ** 2).sum())
    ended = []
    for q in range(0, 200, 20):
        for model in [quantizers.Model("exact", 1), *models]:
            if model.name == "exact":
                d = ((x - x[q]) ** 2).sum(axis=1)
            else:
                turn = quantizers.turn_matrix(8, model.turn) / 8**0.5 if model.turn else np.eye(8)
                decoded = np.stack([np.concatenate([books[model.name][m][c] for m, c in enumerate(codes[k, model.name])]) for k in range(200)])
                d = ((decoded - turn @ x[q]) ** 2).sum(axis=1)
            seen, rounds = slow_walk(d, near, q, limit, 5, first)
            ended.append(rounds)
            assert sorted(got[q, model.name]) == sorted(seen)
            assert all(dist[q, model.name, k] == pytest.approx(d[k]) for k in seen)
    assert max(ended) == limit if limit < 5 else len(set(ended)) > 1 and max(ended) < limit


def test_families_are_trained_and_differ(spark):
    """Seeds, subsets and rotations give other codebooks; the distributed rounds are those of plain k-means."""
    import hashlib

    x, base = vectors(spark, 300, 8)
    models = [quantizers.Model("a", 2), quantizers.Model("b", 2, seed=5), quantizers.Model("c", 2, subset=1), quantizers.Model("d", 4, turn=2)]
    books = quantizers.books_of(quantizers.train_models(base.repartition(7), models, 4, 8, 4))
    again = quantizers.books_of(quantizers.train_models(base.coalesce(1), models, 4, 8, 4))
    assert all((books[m.name] == again[m.name]).all() for m in models) and not (books["a"] == books["b"]).all()
    md5 = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()
    for model in models:
        own = [k for k in range(300) if model.subset is None or md5("subset", model.subset, k) < quantizers.THIRD]
        turn = quantizers.turn_matrix(8, model.turn) / 8**0.5 if model.turn else np.eye(8)
        assert np.allclose(turn @ turn.T, np.eye(8)) and (60 < len(own) < 140 or model.subset is None)
        rows, first = x[own] @ turn.T, sorted(range(len(own)), key=lambda k: md5(model.seed, own[k]))[:4]
        width = 8 // model.parts
        for m in range(model.parts):
            s = rows[:, m * width : (m + 1) * width]
            c = s[first].copy()
            for _ in range(4):
                near = ((s[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.stack([np.round(s[near == k].mean(0), 4) if (near == k).any() else c[k] for k in range(4)])
            assert np.allclose(books[model.name][m], c, atol=2e-4)


def test_own_rows_are_no_neighbours(spark):
    x, base = vectors(spark, 60)
    base = base.union(base.filter("base_id < 3").withColumn("base_id", F.col("base_id") + 100))  # copies stay
    queries = base.filter("base_id % 20 = 0 AND base_id < 100").select(F.col("base_id").alias("query_id"), F.col("be").alias("qe"))
    got = knn.exact_top_k(queries, base, 5, same=True).collect()
    assert all(r["query_id"] != r["base_id"] for r in got) and {(r["base_id"], r["d"]) for r in got if r["query_id"] == 0 and r["rk"] == 1} == {(100, 0.0)}
    edges = graph.knn_graph(base, 8)
    beam = [r for r in graph.beam_search(queries, base, edges, 40, 5, same=True).collect() if r["rank"] is not None]
    assert all(r["query_id"] != r["base_id"] for r in beam) and sorted(r["rank"] for r in beam if r["query_id"] == 20) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="no base vectors"):
        graph.beam_search(queries, base.filter("base_id < 50"), edges, 40, 5)
    with pytest.raises(ValueError, match="length"):
        graph.beam_search(queries.withColumn("qe", F.slice("qe", 1, 3)), base, edges, 40, 5)


def test_training_is_bounded_and_repeats(spark):
    _, base = vectors(spark, 300, 8)
    book = lambda n: sorted((r["m"], r["c"], tuple(r["centroid"])) for r in quantizers.train_codebook(base.repartition(n), 2, 4, 8, 25, per_code=20).collect())
    assert book(1) == book(5) and len(book(2)) == 8
    assert quantizers.train_codebook(base.limit(0), 2, 4, 8).count() == 0


def test_plans_leave_no_views(spark):
    one, two = (spark.createDataFrame([(k, 1.0 * k)], "query_id long, x double") for k in (1, 2))
    first = over(spark, "SELECT x FROM pl_loss", {"loss": one})
    second = over(spark, "SELECT a.x + b.x AS x FROM pl_loss a JOIN pl_loss_of b ON true", {"loss": two, "loss_of": one})
    assert first.collect()[0]["x"] == 1 and second.collect()[0]["x"] == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pl_")]


def test_shared_folder_needs_a_name_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Session())
    assert "plumbline-" in storage.shared_root(spark)
