"""Pruned search: the rows of the whole search, and how much it leaves out."""

import numpy as np
import pytest

from plumbline.operators import balls, knn


def tables(spark, base, queries):
    b = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "base_id long, be array<double>")
    return b, spark.createDataFrame([(k, v.tolist()) for k, v in queries], "query_id long, qe array<double>")


@pytest.mark.parametrize("clusters", [25, 0])
@pytest.mark.parametrize("same", [True, False])
def test_same_rows_for_fewer_pairs(spark, monkeypatch, clusters, same):
    monkeypatch.setattr(balls, "BLOCK", 100)
    rng = np.random.default_rng(clusters)
    centres = 20 * rng.standard_normal((max(1, clusters), 12)) * bool(clusters)
    x = centres[rng.integers(0, len(centres), 2000)] + rng.standard_normal((2000, 12))
    x[100:400] = x[7]  # one vector 300 times, in a ball of several blocks
    base, queries = tables(spark, x, [(k, x[k]) for k in range(0, 2000, 50)] if same else [(k, v) for k, v in enumerate(centres[rng.integers(0, len(centres), 40)] + rng.standard_normal((40, 12)))])
    got, visited = balls.pruned_top_k(queries, base, 5, same=same)
    rows = lambda df: sorted((r["query_id"], r["rk"], r["base_id"], r["d"]) for r in df.collect())
    assert rows(got) == rows(knn.exact_top_k(queries, base, 5, same=same))
    assert visited.of == 2000 * 40 and (visited.pairs < 0.4 * visited.of if clusters else visited.pairs <= visited.of)


def test_small_tables(spark):
    base, queries = tables(spark, np.eye(3), [(9, np.array([1.0, 0.5, 0.0]))])
    got, visited = balls.pruned_top_k(queries, base, 5)
    assert [r["base_id"] for r in sorted(got.collect(), key=lambda r: r["rk"])] == [0, 1, 2] and visited == (3, 3)
    assert balls.pruned_top_k(queries, base.limit(0), 5)[0].count() == 0
    assert balls.pruned_top_k(queries.limit(0), base, 5)[0].count() == 0


def test_no_batch_meets_all_centres_at_once(monkeypatch):
    """A large batch is measured a few rows at a time, and what it sends comes in pieces."""
    import pandas as pd

    met, rough = [], balls.rough_squared_distances
    monkeypatch.setattr(balls, "rough_squared_distances", lambda x, c: met.append(len(x)) or rough(x, c))
    rng = np.random.default_rng(1)
    x, centres = rng.standard_normal((3000, 4)), rng.standard_normal((50, 4))
    rows, sizes, far = pd.DataFrame({"id": np.arange(3000), "vector": list(x), "bound": 100.0}), np.full(50, 9), np.full(50, 9.0)
    sent = [list(run(iter([rows]))) for run in (balls._dealt(centres), balls._first(centres, sizes, 20), balls._rest(centres, far, sizes, 20))]
    assert max(met) <= 256 and [sum(map(len, out)) for out in sent] == [3000, 3 * 3000, 47 * 3000] and max(len(o) for out in sent for o in out) <= 8192
