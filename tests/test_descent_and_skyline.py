"""Graphs by descent against exact ones; skylines against a nested loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import skyline as sky
from plumbline.operators import descent, graph


def clustered(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 24))
    x = centres[rng.integers(0, 40, n)] + 0.7 * rng.standard_normal((n, 24))
    return spark.createDataFrame([(k * 3, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")


def test_recall_and_growth(spark):
    """Nine of ten edges are those of the exact graph; eight times the vectors take far less than 64 times the pairs."""
    measured = {}
    for n in (500, 4000):
        base = clustered(spark, n)
        edges, report = descent.build(base, 10)
        got, want = ({(r["src"], r["dst"]) for r in e.collect()} for e in (edges, graph.knn_graph(base, 10)))
        assert len(got) == 10 * n and len(got & want) / len(want) >= 0.9
        assert report.changes[-1] < report.changes[0] and report.rounds == len(report.pairs) < 15
        measured[n] = report.leaf_pairs + sum(report.pairs)
    assert measured[4000] < 20 * measured[500] and measured[4000] < 4000 * 4000 / 2 / 3


def test_descent_repeats_and_takes_small_tables(spark):
    base = clustered(spark, 120, 3)
    one, two = (sorted(map(tuple, descent.build(b, 5)[0].collect())) for b in (base, base.repartition(5)))
    assert one == two
    copies = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(150)], "base_id long, be array<double>")
    assert descent.build(copies, 4)[0].count() == 600
    for n, want in ((0, 0), (1, 0), (3, 6)):
        assert descent.build(clustered(spark, max(n, 1)).limit(n), 5)[0].count() == want


def slow(points):
    return {k for k, p in enumerate(points) if not any((q >= p).all() and (q > p).any() for q in points)}


@pytest.mark.parametrize("block", [7, 8192])
def test_skyline(spark, monkeypatch, block):
    monkeypatch.setattr(sky, "BLOCK", block)
    rng = np.random.default_rng(1)
    points = np.round(rng.random((800, 3)) + np.array([[0, 0, 1]]) * (1 - rng.random((800, 1))), 1)
    points[5] = points[6] = [3.0, -1.0, 0.0]
    rows = [(k, *map(float, p)) for k, p in enumerate(points)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, float("nan"), 9.0, 9.0)], "id long, x double, y double, z double")
    got = sky.skyline(df, ["x"], ["y", "z"])
    signed = points * np.array([1, -1, -1])
    assert got.columns == df.columns and {r["id"] for r in got.collect()} == slow(signed) and got.count() == len(slow(signed))
    assert sky.skyline(df.limit(0), ["x"], ["y"]).count() == 0


def test_skyline_of_a_million(spark):
    df = spark.range(10**6, numPartitions=8).select("id", *[F.rand(seed).alias(c) for seed, c in ((1, "x"), (2, "y"), (3, "z"))])
    found = sky.skyline(df, ["x", "y", "z"]).toPandas()
    sample = df.filter("id % 997 = 0").toPandas()
    best = found[["x", "y", "z"]].to_numpy()
    assert not sky.dominated(best, best).any() and 20 < len(best) < 500
    rest = sample[~sample["id"].isin(found["id"])][["x", "y", "z"]].to_numpy()
    assert sky.dominated(rest, best).all()


def test_vectors_go_to_groups_with_newcomers_only(spark, monkeypatch):
    kept, whole = [], descent.materialize
    monkeypatch.setattr(descent, "materialize", lambda df: kept.append(whole(df)) or kept[-1])
    x = np.random.default_rng(6).standard_normal((150, 4)).astype(np.float32).astype(float)
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base_id long, be array<double>")
    descent.build(base, 4, limit=4)
    assert dict(kept[0].dtypes)["vector"] == "array<float>"
    members = [df.toPandas() for df in kept if df.columns == ["v", "id", "fresh"]]
    assert len(members) > 1 and all(m.groupby("v")["fresh"].any().all() for m in members)
    assert members[-1]["v"].nunique() < 150
