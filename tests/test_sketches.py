"""Sketches of quantiles: their error, sums of sketches, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import sketches


def test_error_and_sums(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.exp(rng.normal(0, 3, 4000)), np.zeros(300), -np.exp(rng.normal(0, 1, 500))])
    rows = [(str(k % 3), str(k % 7), float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    fine = sketches.sketch(df, "x", ["a", "b"])
    whole = sketches.sketch(df, "x")
    assert sorted(map(tuple, sketches.merged(fine).collect())) == sorted(map(tuple, whole.collect()))
    by_a = sketches.merged(fine, ["a"])
    assert sorted(map(tuple, by_a.collect())) == sorted(map(tuple, sketches.sketch(df, "x", ["a"]).collect()))
    points = [0.01, 0.1, 0.5, 0.9, 0.99]
    for r in sketches.quantiles(by_a, points, ["a"]).collect():
        own = sorted(v for a, _, v in rows if a == r["a"])
        assert r["n"] == len(own)
        for p in points:
            want = own[int(np.ceil(p * len(own))) - 1]
            assert abs(r[f"q{round(100 * p):02d}"] - want) <= abs(want) * sketches.ERROR + 2 / sketches.UNITS
    assert whole.count() < 3000


def test_odd_values(spark):
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), -float("inf"), 1e300, 0.0, -0.0, 3.0)], "x double")
    assert sorted(map(tuple, sketches.sketch(df, "x").collect())) == [(0, 2), (3 * sketches.UNITS, 1)]
    none = sketches.sketch(df.limit(0), "x")
    assert [tuple(r) for r in sketches.quantiles(none, [0.5]).collect()] == [(None, None)] and sketches.quantiles(none.withColumn("g", F.lit(1)), [0.5], ["g"]).count() == 0
    (r,) = df.filter("x = 3").select(sketches.step(F.col("x")).alias("s")).collect()
    assert r["s"] / sketches.UNITS == pytest.approx(3.0)
