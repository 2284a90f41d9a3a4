"""Draws within a task against the SQL text, window by window."""

import numpy as np
import pytest

from plumbline.operators import permutations
from plumbline.plans import core, relations
from plumbline.plans.core import RELATIONS, SPARK, over

RANKED = "query_id long, model string, pos long, base_id long, exact double, score double, er long, sr long, in_gt long"


@pytest.fixture
def ranked(spark):
    """Pools of 1, 7, 10, 41 and 47 candidates, with ties and with truth that isn't in the order of distance."""
    draw, rows = np.random.default_rng(3), []
    for q, n in enumerate((1, 7, 10, 41, 47)):
        exact = draw.integers(0, 60, n) / 4.0
        for model in ("coarse", "fine"):
            score = exact + draw.integers(-8, 9, n) / 4.0
            er, sr = (np.argsort(np.lexsort((np.arange(n), x))) + 1 for x in (exact, score))
            rows += [(20 * q, model, k, int(1000 * q + 7 * k), float(exact[k]), float(score[k]), int(er[k]), int(sr[k]), int(k % 3 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, RANKED)


def same(spark, name, ranked, columns):
    made = RELATIONS[name].build(spark, None, lambda _: ranked)
    assert made.columns == columns and not {"Window", "Join", "Expand"} & set(made._jdf.queryExecution().optimizedPlan().toString().split())
    want = over(spark, RELATIONS[name].body(SPARK), {"ranked": ranked}).select(*columns)
    assert made.schema.simpleString() == want.schema.simpleString()
    return sorted(map(tuple, made.collect())), sorted(map(tuple, want.collect()))


def test_draws_without_a_row_a_candidate(spark, ranked, monkeypatch):
    monkeypatch.setattr(relations, "DRAWS", 4)
    got, want = same(spark, "nulls", ranked, ["query_id", "model", "condition", "draw", "loss_hits", "displaced"])
    assert got == want and len(got) == 5 * 2 * 6 * 4 and any(r[4] for r in got) and any(r[5] for r in got)
    assert RELATIONS["nulls"].build(spark, None, lambda _: ranked.limit(0)).count() == 0


def test_errors_of_displaced_and_intruders(spark, ranked, monkeypatch):
    monkeypatch.setattr(relations, "DRAWS", 4)
    coarse = ranked.filter("model = 'coarse'")
    got, want = same(spark, "shuffled", ranked, ["query_id", "draw", "base_id", "e"])
    crossed = {(r["query_id"], r["base_id"]) for r in coarse.collect() if (r["er"] <= relations.K) != (r["sr"] <= relations.K)}
    assert crossed and got == [r for r in want if (r[0], r[2]) in crossed]
    whole = core.over(spark, RELATIONS["shuffled"].body(SPARK), {"ranked": ranked})
    run = lambda shuffled: sorted(map(tuple, core.run(spark, "replacement_null", shuffled=shuffled, ranked=ranked).collect()))
    assert run(RELATIONS["shuffled"].build(spark, None, lambda _: ranked)) == run(whole) != []


def test_pairs_are_never_broadcast(spark, ranked, monkeypatch):
    monkeypatch.setattr(relations, "DRAWS", 4)
    shuffled = RELATIONS["shuffled"].build(spark, None, lambda _: ranked)
    plan = core.run(spark, "replacement_null", shuffled=shuffled, ranked=ranked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2


def test_equal_leading_halves_of_hashes(monkeypatch):
    class Fixed:
        def __init__(self, x):
            self.x = x

        def digest(self):
            return bytes(8) + (99 - int(self.x.split(b":")[3])).to_bytes(8, "big")

    monkeypatch.setattr(permutations.hashlib, "md5", Fixed)
    assert permutations.hash_orders(0, np.arange(5), 2).tolist() == [[4, 3, 2, 1, 0]] * 2


@pytest.mark.parametrize("n,want", [(3, [0, 1, 2]), (6, [0, 0, 1, 1, 2, 3]), (8, [0, 0, 1, 1, 2, 2, 3, 3])])
def test_bins(n, want):
    assert permutations.bins(n, None).tolist() == want
    assert permutations.bins(n, (1, 2)).tolist() == [0, 1, *[2] * (n - 2)]


def test_draws_are_averaged_before_the_join(spark, ranked, monkeypatch):
    monkeypatch.setattr(relations, "DRAWS", 4)
    nulls = RELATIONS["nulls"].build(spark, None, lambda _: ranked)
    found = core.run(spark, "replacement_counts", nulls=nulls, ranked=ranked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("avg(cast(displaced")
