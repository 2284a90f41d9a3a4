"""Places and running sums over a whole order, or over hot groups, without one task that sees them all.

Rows are dealt into ranges of (group, key, ties), so equal keys split as well. A
window ranks the rows of a range; what came before a range is a sum of the
ranges' counts. Only a group or key at the edge of a range lies in several, so
what is handed back to the rows has a few rows a range, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]):
    out = F.lit(True)
    for n in names:
        out &= a[n].eqNullSafe(b[f"{n}_b"])
    return out


def _back(rows: DataFrame, few: DataFrame, names: Sequence[str], fill: dict) -> DataFrame:
    """``few`` has a row or two a range: it is bounded by the number of ranges."""
    other = few.select(*[F.col(n).alias(f"{n}_b") for n in names], *fill)
    return rows.join(F.broadcast(other), _same(rows, other, names), "left").drop(*[f"{n}_b" for n in names]).fillna(0, [c for c, v in fill.items() if v])


def placed(df: DataFrame, key: Sequence[str], ties: Sequence[str] = (), group: Sequence[str] = (), weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Rows with their place in the order of ``key`` and ``ties``, ascending, nulls last, within ``group``.

    Adds ``r_`` (from 1), ``first_`` and ``last_`` (places of the first and the last
    row with an equal key: their mean is the average rank), ``n_`` (rows of the group),
    and with ``weight`` ``upto_`` (its sum up to the row) and ``sum_`` (of the group).
    Rows alike in group, key and ties have any order among themselves. An empty table
    gives no rows; a null group is a group.
    """
    group, key, ties = list(group), list(key), list(ties)
    asc = lambda names: [F.col(n).asc_nulls_last() for n in names]
    cut = asc(dict.fromkeys(group + key + ties))
    dealt = df.repartitionByRange(ranges, *cut) if ranges else df.repartitionByRange(*cut)
    rows = materialize(dealt.withColumn("part_", F.spark_partition_id()))
    w = F.col(weight) if weight else F.lit(0)

    chunks = rows.groupBy("part_", *group).agg(F.count(F.lit(1)).alias("c_"), F.sum(w).alias("w_"))
    upto = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # a window over ranges: one row a range where there is no group
    chunks = chunks.select("part_", *group, F.sum("c_").over(upto).alias("before_"), F.sum("w_").over(upto).alias("less_"), F.sum("c_").over(whole).alias("n_"), F.sum("w_").over(whole).alias("sum_"), F.count(F.lit(1)).over(whole).alias("parts_"))
    spread = materialize(chunks.filter("parts_ > 1"))

    inside = ["part_", *group]
    by = Window.partitionBy(*inside)
    ordered = by.orderBy(*asc(key + ties)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*inside, *key)
    rows = rows.withColumn("r_", F.row_number().over(by.orderBy(*asc(key + ties))).cast("long"))
    rows = rows.withColumn("first_", F.rank().over(by.orderBy(*asc(key))).cast("long")).withColumn("last_", F.col("first_") + F.count(F.lit(1)).over(peers) - 1)
    rows = rows.withColumn("own_", F.count(F.lit(1)).over(by))
    if weight:
        rows = rows.withColumn("upto_", F.sum(w).over(ordered)).withColumn("all_", F.sum(w).over(by))
    rows = rows.withColumn("edge_", (F.col("first_") == 1) | (F.col("last_") == F.col("own_")))
    rows = _back(rows, spread, inside, {"before_": True, "less_": True, "n_": False, "sum_": False, "parts_": False})
    rows = rows.withColumn("n_", F.coalesce("n_", "own_"))
    for c in ("r_", "first_", "last_"):
        rows = rows.withColumn(c, F.col(c) + F.col("before_"))
    if weight:
        rows = rows.withColumn("upto_", F.col("upto_") + F.col("less_")).withColumn("sum_", F.coalesce("sum_", "all_")).drop("all_")
    else:
        rows = rows.drop("sum_")

    # keys that lie in several ranges are the first or the last of a group's part there
    ends = rows.filter(F.col("edge_") & F.col("parts_").isNotNull()).groupBy(*group, *key).agg(F.min("first_").alias("low_"), F.max("last_").alias("high_"), F.countDistinct("part_").alias("in_")).filter("in_ > 1")
    rows = _back(rows, materialize(ends), group + key, {"low_": False, "high_": False})
    return rows.withColumn("first_", F.coalesce("low_", "first_")).withColumn("last_", F.coalesce("high_", "last_")).drop("part_", "own_", "edge_", "before_", "less_", "parts_", "low_", "high_")
