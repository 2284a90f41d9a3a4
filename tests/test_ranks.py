"""Places in an order and in groups against plain sorting, with hot keys and hot groups."""

import random

import pytest

from plumbline.functions.ranks import placed


def slow(rows, group, key, ties, weight=None):
    out = {}
    last = (1, 0)
    order = lambda v: last if v is None else (0, v)
    by = {}
    for r in rows:
        by.setdefault(tuple(r[c] for c in group), []).append(r)
    for members in by.values():
        members.sort(key=lambda r: [order(r[c]) for c in key + ties])
        places, total, sums = {}, 0, []
        for k, r in enumerate(members, 1):
            places.setdefault(tuple(r[c] for c in key), []).append(k)
            total += r[weight] if weight else 0
            sums.append(total)
        for k, r in enumerate(members, 1):
            p = places[tuple(r[c] for c in key)]
            out[r["id"]] = (k, p[0], p[-1], len(members)) + ((sums[k - 1], total) if weight else ())
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_places(spark, ranges, group):
    rng = random.Random(ranges)
    rows = [{"id": k, "g": rng.choice([None, "a", "b"]) if k % 3 else "hot", "x": 1.5 if k % 10 else rng.choice([None, rng.random() * 9]), "w": rng.randint(0, 5)} for k in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, x double, w long")
    got = placed(df, ["x"], ["id"], group, weight="w", ranges=ranges)
    assert {r["id"]: (r["r_"], r["first_"], r["last_"], r["n_"], r["upto_"], r["sum_"]) for r in got.collect()} == slow(rows, group, ["x"], ["id"], "w")


def test_hot_key_is_split(spark):
    """Nine of ten keys are equal; no range has over twice the mean."""
    df = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, id, 7) AS x")
    cut = df.repartitionByRange(8, "x", "id").rdd.glom().map(len).collect()
    assert max(cut) < 2 * 20_000 / 8
    got = placed(df, ["x"], ["id"], ranges=8)
    assert got.filter("x = 7").select("first_", "last_").distinct().collect() == [(2, 18_001)]
    assert got.agg({"r_": "sum"}).first()[0] == 20_000 * 20_001 // 2


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, x double")
    assert placed(none, ["x"], ["id"]).collect() == []
    one = spark.createDataFrame([(1, None)], "id long, x double")
    assert [(r["r_"], r["first_"], r["last_"], r["n_"]) for r in placed(one, ["x"], [], ["id"]).collect()] == [(1, 1, 1, 1)]
