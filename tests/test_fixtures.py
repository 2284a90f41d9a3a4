"""Hand fixtures: small inputs with known results."""

import numpy as np
import pytest

from plumbline.functions import vectors as V
from plumbline.operators import graph, knn, quantizers
from plumbline.plans import core, relations
from plumbline.plans.core import RELATIONS, SPARK, over
from plumbline.sources import records, xvecs
from plumbline.streaming import refinement


def _scored(spark, exact, score, model="coarse", query=0, ids=None):
    ids = ids or list(range(len(exact)))
    rows = [(query, k, i, float(d), model, float(s)) for k, (i, d, s) in enumerate(zip(ids, exact, score))]
    return spark.createDataFrame(rows, "query_id long, pos long, base_id long, exact double, model string, score double")


def _gt(spark, ids, query=0):
    return spark.createDataFrame([(query, i, float(k), k + 1) for k, i in enumerate(ids)], "query_id long, base_id long, d double, rk int")


@pytest.fixture
def two(monkeypatch):
    monkeypatch.setattr(relations, "K", 2)


def _ranked(spark, scored, gt):
    return over(spark, RELATIONS["ranked"].body(SPARK), {"scored": scored, "gt": gt})


def test_exact_neighbors(spark):
    base = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate([0, 3, 10, 20])], "base_id long, be array<double>")
    queries = spark.createDataFrame([(0, [2.0])], "query_id long, qe array<double>")
    got = sorted(knn.exact_top_k(queries, base, 3).collect(), key=lambda r: r["rk"])
    assert [(r["base_id"], r["d"]) for r in got] == [(1, 1.0), (0, 4.0), (2, 64.0)]


def test_ties_go_to_the_smaller_id_across_blocks(spark):
    base = spark.createDataFrame([(k, [float(k % 3)]) for k in range(60)], "base_id long, be array<double>")
    queries = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "query_id long, qe array<double>")
    b = base.selectExpr("base_id AS id", "be AS vector")
    q = queries.selectExpr("query_id AS id", "qe AS vector")
    got = knn.blocked_top_k(q, b, 5, ("query_id", "base_id", "d"), block=7).collect()
    for key, first in ((0, 0), (1, 1)):
        assert [r["base_id"] for r in sorted(got, key=lambda r: r["rk"]) if r["query_id"] == key] == [first + 3 * k for k in range(5)]


def test_stable_rerank_keeps_pool_order_on_ties(spark, two):
    ranked = _ranked(spark, _scored(spark, [1, 1], [9, 8], ids=[1, 0]), _gt(spark, [0, 1])).collect()
    assert [r["base_id"] for r in sorted(ranked, key=lambda r: r["er"])] == [1, 0]


@pytest.mark.parametrize(
    "exact,score,truth,name",
    [([1, 2, 3], [1, 2, 3], [0, 1], "Stable"), ([1, 2, 3], [1, 4, 3], [0, 1], "Harmful"), ([1, 2, 3], [1, 4, 3], [0, 9], "Benign"), ([1, 2, 2], [1, 4, 2], [0, 2], "Lucky")],
)
def test_classes(spark, two, exact, score, truth, name):
    ranked = _ranked(spark, _scored(spark, exact, score), _gt(spark, truth))
    assert over(spark, RELATIONS["perq"].body(SPARK), {"ranked": ranked}).first()["class"] == name


def test_inversions(spark, two):
    ranked = _ranked(spark, _scored(spark, [1, 2, 3, 4, 5], [1, 7, 2, 3, 8]), _gt(spark, [0, 1]))
    got = over(spark, RELATIONS["inversions"].body(SPARK), {"ranked": ranked}).collect()
    assert {(r["inside_id"], r["outside_id"], r["margin"], r["violation"]) for r in got} == {(1, 2, 1.0, 5.0), (1, 3, 2.0, 4.0)}


def test_exact_ties_never_invert(spark, two):
    ranked = _ranked(spark, _scored(spark, [1, 2, 2], [1, 3, 2]), _gt(spark, [0, 1]))
    assert over(spark, RELATIONS["inversions"].body(SPARK), {"ranked": ranked}).count() == 0


def test_transition_states(spark, two):
    exact = [1, 2, 3, 4, 5]
    scored = _scored(spark, exact, [1, 6, 2, 3, 4]).union(_scored(spark, exact, [4, 2, 1, 5, 6], "fine"))
    made = {"scored": scored, "ranked": _ranked(spark, scored, _gt(spark, [0, 1]))}
    for name in ("inversions", "perq", "random_pairs", "metrics"):
        made[name] = over(spark, RELATIONS[name].body(SPARK), made)
    pairs = lambda p: {(i, j) for i in range(2) for j in range(2, 5) if p[i] > p[j]}
    a, b = pairs([1, 6, 2, 3, 4]), pairs([4, 2, 1, 5, 6])
    (r,) = core.run(spark, "inversion_transition", inversions=made["inversions"], perq=made["perq"], metrics=made["metrics"]).collect()
    assert {k: r[f"{k}_pairs"] for k in ("corrected", "persistent", "new")} == {"corrected": len(a - b), "persistent": len(a & b), "new": len(b - a)}
    assert r["coarse_adds_up"] and r["fine_adds_up"]


def test_native_heap():
    assert graph.native_heap([8, 3, 1, 9], [4, 4, 4, 2], 2) == [9, 3]


def test_gap(spark):
    perq = lambda n: spark.createDataFrame([(0, "coarse", n, 8.0, 11.0)], "query_id long, model string, n long, s9 double, s12 double")
    gap = lambda n: over(spark, RELATIONS["gaps"].body(SPARK), {"perq": perq(n)}).first()["gap"]
    assert gap(20) == 3 and gap(11) == float("inf")


def test_quantizer_round_trip(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")
    subs = quantizers.sub_vectors(base, 2, 8)
    book = quantizers.lloyd(subs, quantizers.first_codebook(base, 2, 4, 8), 2)
    table = {(r["m"], r["c"]): np.array(r["centroid"]) for r in book.collect()}
    centres = [x[:4, 4 * m : 4 * m + 4].copy() for m in range(2)]
    for m in range(2):
        part = x[:, 4 * m : 4 * m + 4]
        for _ in range(2):
            near = ((part[:, None] - centres[m][None]) ** 2).sum(-1).argmin(1)
            centres[m] = np.stack([part[near == c].mean(0) if (near == c).any() else centres[m][c] for c in range(4)])
        assert all(np.allclose(table[m, c], centres[m][c]) for c in range(4))
    codes = quantizers.encode(subs, book)
    decoded = {r["base_id"]: np.array(r["decoded"]) for r in quantizers.decode(codes, book).collect()}
    queries = spark.createDataFrame([(0, x[0].tolist())], "query_id long, qe array<double>")
    for r in quantizers.adc_top_k(queries, codes, book, 10).collect():
        assert r["adc"] == pytest.approx(((x[0] - decoded[r["base_id"]]) ** 2).sum())


def test_vector_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.squared_l2(F.col("a"), F.col("b")).alias("d"), V.normalize(F.col("a")).alias("n"), V.normalize(F.col("b")).alias("z"), V.guarded_ratio(F.lit(1.0), F.element_at("b", 1)).alias("r"), V.quantize(F.col("b"), 0.25, 0.1).alias("q")).collect()
    assert got[0]["d"] == 25 and got[0]["n"] == [0.6, 0.8] and got[0]["z"] is None and got[0]["r"] is None and got[1]["n"] is None and got[1]["r"] == 1


def test_beam_finds_what_is_near(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")
    queries = spark.createDataFrame([(k, rng.standard_normal(6).tolist()) for k in range(5)], "query_id long, qe array<double>")
    edges = graph.knn_graph(base, 8)
    got = graph.beam_search(queries, base, edges, 64, 10).collect()
    truth = {(r["query_id"], r["base_id"]) for r in knn.exact_top_k(queries, base, 10).collect()}
    results = {(r["query_id"], r["base_id"]) for r in got if r["rank"] is not None}
    pool = [(r["query_id"], r["base_id"]) for r in got if r["phase"] == "level0"]
    assert len(pool) == len(set(pool)) and results <= set(pool) and len(results & truth) / len(truth) > 0.8
    merged = {(r["query_id"], r["base_id"]) for r in graph.sharded_beam_search(queries, base, 8, 64, 10, shard=150).collect()}
    assert len(merged) == 50 and len(merged & truth) / len(truth) > 0.9
    hops = graph.expand(queries.selectExpr("query_id", "CAST(0 AS LONG) AS base_id"), edges, 2).collect()
    assert len({(r["query_id"], r["base_id"]) for r in hops}) == len(hops) and {r["hop"] for r in hops} == {0, 1, 2}


def test_vector_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xvecs, "RANGE", 24)
    base = np.array([[0, 1], [2, 3], [4, 5]])
    (tmp_path / "b.fvecs").write_bytes(xvecs.pack(base))
    (tmp_path / "g.ivecs").write_bytes(xvecs.pack(np.array([[2, 1, 0], [0, 1, 2]]), "i"))
    got = sorted(map(tuple, xvecs.read_xvecs(spark, str(tmp_path / "b.fvecs")).collect()))
    assert got == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    truth = xvecs.read_xvecs(spark, str(tmp_path / "g.ivecs"), "i")
    assert [r["embedding"][:2] for r in truth.orderBy("vec_id").collect()] == [[2, 1], [0, 1]]
    with pytest.raises(ValueError):
        xvecs.unpack(xvecs.pack(base)[:-1], 2)
    with pytest.raises(ValueError):
        xvecs.unpack(xvecs.pack(base[:, :1]) + xvecs.pack(base[:1]) + b"\0" * 4, 1)
    with pytest.raises(ValueError):
        xvecs.unpack(xvecs.pack(np.array([[-1]]), "i"), 1, "i")


def test_record_files(spark, tmp_path):
    raw = np.array([(3, 1.5, 2.5), (1, 0.5, 0.25)], dtype=records.RECORD).tobytes()
    rows = spark.createDataFrame([(7, bytearray(raw))], "query_id long, content binary")
    assert [tuple(r) for r in records.unpack_candidates(rows).collect()] == [(7, 0, 3, 1.5, 2.5), (7, 1, 1, 0.5, 0.25)]
    path = tmp_path / "c.conf"
    path.write_text("# a\nef=16,64\npq = 8:4,8:8  # sizes\n")
    got = records.read_config(spark, str(path), {"ef", "pq"})
    assert records.list_value(got["ef"]) == [("16",), ("64",)] and records.list_value(got["pq"]) == [("8", "4"), ("8", "8")]
    path.write_text("a=1\na=2\n")
    with pytest.raises(ValueError):
        records.read_config(spark, str(path))
    records.write_tables([spark.range(2).toDF("x"), spark.range(1).toDF("y")], str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["x", "y"]


def test_refinement_batches(spark):
    exact, score = list(range(20)), [20 - k for k in range(20)]
    scored = _scored(spark, exact, score).drop("model")
    queries = spark.createDataFrame([(0,), (0,)], "query_id long")
    native = [r["base_id"] for r in sorted(refinement.refine(queries, scored, -1.0).collect(), key=lambda r: r["rank"])]
    refined = [r["base_id"] for r in sorted(refinement.refine(queries, scored, 3.0).collect(), key=lambda r: r["rank"])]
    assert native == list(range(19, 9, -1)) and refined == list(range(4, 14))
