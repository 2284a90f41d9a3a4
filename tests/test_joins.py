"""Tables that grow with the input never go through the driver, and codes of several models stay apart."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import graph, quantizers

SOURCES = ["exact", "b"]


def tables(spark, models):
    draw = np.random.default_rng(4)
    x = draw.integers(0, 9, (30, 4)).astype(float)
    books = {m.name: draw.integers(0, 9, (m.parts, 3, 4 // m.parts)).astype(float) for m in models}
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 30, 10)], "query_id long, qe array<double>")
    return x, books, base, queries, quantizers.encode_models(base, models, books)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pools_are_scored_by_merging(spark, monkeypatch):
    monkeypatch.setattr(quantizers, "SCORED", 7)
    models = [quantizers.Model("z", 2), quantizers.Model("b", 1), quantizers.Model("t", 4, turn=1)]
    x, books, base, queries, coded = tables(spark, models)
    pool = spark.createDataFrame([(q, p, (q + p + 1) % 30, float(p)) for q in range(0, 30, 10) for p in range(20)], "query_id long, pos long, base_id long, adc double")
    found = quantizers.score_pool(pool, queries, base, coded, models, books, "own")
    assert plan(found).count("strategy=merge") == 3
    codes = {(r["base_id"], r["model"]): np.array([r["codes"]]) for r in coded.collect()}
    got = found.collect()
    assert len(got) == 60 * 4
    for r in got:
        q, b = x[r["query_id"]], x[r["base_id"]]
        model = {m.name: m for m in models}.get(r["model"])
        want = float(r["pos"]) if model is None else quantizers.code_distances(quantizers.turned(q[None], model.turn), codes[r["base_id"], model.name], books[model.name])[0]
        assert (r["score"], r["exact"]) == (want, ((q - b) ** 2).sum())


def test_walks_merge_and_measure_a_pair_once(spark):
    models = [quantizers.Model("b", 2)]
    x, books, base, queries, coded = tables(spark, models)
    edges, luts = graph.knn_graph(base, 4), quantizers.lookup_tables(queries, models, books)
    found = graph.walk(queries, base, edges, coded, luts, SOURCES, 6, 4, 4, 3)
    assert "strategy=merge" in plan(found) and "strategy=broadcast" not in plan(found)
    rows = found.collect()
    assert all(r["exact"] == ((x[r["query_id"]] - x[r["base_id"]]) ** 2).sum() for r in rows)
    keys = [(r["query_id"], r["model"], r["base_id"]) for r in rows]
    assert len(keys) == len(set(keys)) and {m for _, m, _ in keys} == set(SOURCES)
    assert {(q, b) for q, m, b in keys if m == "b"} - {(q, b) for q, m, b in keys if m == "exact"}
    assert all(r["exact"] == r["dist"] for r in rows if r["model"] == "exact")


def test_no_vector_is_sent_for_a_pair_that_only_models_came_to(spark, monkeypatch):
    """Such pairs are measured by blocks; vectors of FLOAT components are sent as such, others aren't rounded."""
    models, seen, whole = [quantizers.Model("b", 2)], [], graph.measured
    monkeypatch.setattr(graph, "measured", lambda pairs, queries, base: seen.append(dict(base.dtypes)["be"]) or whole(pairs, queries, base))
    monkeypatch.setattr(graph, "MEASURED", 10)
    x, books, base, queries, coded = tables(spark, models)
    edges, luts = graph.knn_graph(base, 4), quantizers.lookup_tables(queries, models, books)
    for move in (0.0, 1e-12):
        moved = base.withColumn("be", F.transform("be", lambda v: v + move))
        for r in graph.walk(queries, moved, edges, coded, luts, SOURCES, 2, 4, 4, 3).collect():
            d = x[r["query_id"]] - (x[r["base_id"]] + move)
            assert r["exact"] == (d * d).cumsum()[-1]
    assert seen == ["array<float>", "array<double>"]
