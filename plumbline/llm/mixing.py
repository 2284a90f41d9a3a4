"""Mixing sources to target weights by nested hash thresholds.

Every row has a 60-bit hash of its id. Sizes are summed by source and the
leading 12 bits; the bucket in which a source's budget ends is found by a
running sum over at most 4096 sums of a source; only rows of that bucket are
summed again by the next 12 bits, and so on. The result is a threshold for each
source, so rows are chosen by a filter and never sorted.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own and comes last; rows with the same id share their hash and are taken
or left together; an empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize

#: Bits of the hash that one level of histograms resolves, and the levels.
BITS, LEVELS = 12, 5


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the decimal id (of '' for a null id)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], total_share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size)`` -> one row a source with its ``target``.

    Water filling in closed form: sources in ascending order of cap over weight
    stay at their cap as long as it is below the level at which the rest would
    share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("ceiling", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("ceiling") / F.col("weight"))
    left = F.lit(total_share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight_left)
    level = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level"))).over(whole)["level"]
    return leveled.withColumn("open_level", level).select(
        "source", "source_size", F.when(F.col("full_at") <= F.col("level"), F.col("ceiling")).otherwise(F.col("open_level") * F.col("weight")).alias("target")
    )


def thresholds(rows: DataFrame, weights: Sequence[int], total_share: float, cap: float) -> tuple[DataFrame, int]:
    """``s, source_size, target, whole, threshold`` of each source of ``rows(source, size, h)``, and their number.

    A row is taken ``whole`` times, and once more if its hash is below the
    threshold: the largest for which the sum stays within the target.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, total_share, cap))
    n_sources = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("prefix", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = 60 - BITS * level
        same = broadcast_if_small(plan.select(F.col("source").alias("s"), "prefix"), n_sources)
        edge = rows.join(same, rows["source"].eqNullSafe(same["s"]) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = edge.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        got = sums.withColumn("upto", upto).join(
            broadcast_if_small(plan.select(F.col("source").alias("s"), "budget", "used"), n_sources), F.col("source").eqNullSafe(F.col("s"))
        )
        # the first bucket in which the budget ends; none: every row fits
        ends = got.filter(F.col("used") + F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", F.col("used").alias("base"), "upto", "n")).alias("e"))
        ends = ends.select(F.col("source").alias("s"), F.col("e.bucket").alias("edge"), (F.col("e.base") + F.col("e.upto") - F.col("e.n")).alias("edge_used"))
        plan = materialize(
            plan.join(broadcast_if_small(ends, n_sources), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "whole", "budget", F.coalesce("edge", F.lit(1 << (BITS * level)).cast("long")).alias("prefix"), F.coalesce("edge_used", "used").alias("used")
            )
        )
    return plan.select(F.col("source").alias("s"), "source_size", "target", "whole", F.col("prefix").alias("threshold")), n_sources


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash60(F.col(f"`{id_col}`")).alias("h"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of ``docs``.

    ``taken`` is a multiple of ``size``.
    """
    rows = materialize(_measured(docs, id_col, text_col, source_col))
    plan, n_sources = thresholds(rows, weights, total_share, cap)
    chosen = broadcast_if_small(plan, n_sources)
    return rows.join(chosen, rows["source"].eqNullSafe(chosen["s"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))).alias("taken"), "source"
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they are.

    The thresholds go to the rows, so no text is shuffled. Rows without a word
    weigh nothing and stay as they are.
    """
    rows = materialize(_measured(docs, "doc_id", "text", "source"))
    plan, n_sources = thresholds(rows, weights, total_share, cap)
    chosen = broadcast_if_small(plan.select(F.col("s").alias("__plumbline_source"), F.struct("whole", "threshold").alias("__plumbline_plan")), n_sources)
    extra = F.when(hash60(docs["doc_id"]) < F.col("__plumbline_plan.threshold"), 1).otherwise(0)
    copies = F.when(F.coalesce(docs["text"].rlike(WORD), F.lit(False)), (F.col("__plumbline_plan.whole") + extra).cast("int")).otherwise(F.lit(1))
    joined = docs.join(chosen, docs["source"].eqNullSafe(F.col("__plumbline_source"))).withColumn("__plumbline_copies", copies).filter("__plumbline_copies > 0")
    return joined.withColumn("__plumbline_copy", F.explode(F.expr("sequence(1, __plumbline_copies)"))).select(*[joined[c] for c in docs.columns])
