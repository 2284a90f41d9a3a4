"""Quantile sketches that add up: counts by step of a value's leading bits.

A value is taken in units of 2**-20 and keeps its seven leading bits, so a step is at
most a sixty-fourth of the value wide (and a unit at least). The sketch of a union of
rows is the sum of their sketches, whatever the order, so one pass gives the sketches
of the finest groups, and those of any coarser ones come from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of one, leading bits that stay, and the error of a quantile as a share of it.
UNITS, BITS = 1 << 20, 7
ERROR = 2.0 ** -(BITS - 1)


def step(value: Column) -> Column:
    """The lower end of a value's step, in units; the same on both sides of zero, null for a null or what isn't finite."""
    size = F.floor(F.abs(value) * UNITS).cast("long")
    cut = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", size, cut), cut)
    return F.when(F.abs(value) < 2.0**42, F.when(value < 0, -low).otherwise(low))


def sketch(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, step, n``: rows without a finite value below 2**42 are left out."""
    return df.select(*by, step(F.col(value).cast("double")).alias("step")).filter("step IS NOT NULL").groupBy(*by, "step").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups, or of several tables of sketches together."""
    return sketches.groupBy(*by, "step").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, n, q<percent>``: the step that holds the row of rank ceil(p * n), by its lower end.

    A window sees the steps of a group, of which there are some thousands at most. An
    empty sketch gives a row of nulls without groups, and none with them.
    """
    part = Window.partitionBy(*by)
    run = sketches.withColumn("upto", F.sum("n").over(part.orderBy("step"))).withColumn("of", F.sum("n").over(part))
    picked = [(F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("of")), F.col("step"))) / UNITS).alias(f"q{round(p * 100):02d}") for p in points]
    return run.groupBy(*by).agg(F.max("of").alias("n"), *picked)
