"""Rows that no other row dominates, by local skylines and blocks of what they leave."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of a block of the second pass, and of what is compared at a time.
BLOCK, TOGETHER = 8192, 256


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some row of ``by`` beats: at least as much everywhere, more somewhere."""
    out = np.zeros(len(points), dtype=bool)
    for a in range(0, len(points), TOGETHER):
        p = points[a : a + TOGETHER, None, :]
        out[a : a + TOGETHER] = ((by[None] >= p).all(-1) & (by[None] > p).any(-1)).any(1)
    return out


def local(points: np.ndarray) -> np.ndarray:
    """Places of the points that no other one dominates. In descending order of their sums none is beaten by a later one."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    held = np.zeros(0, dtype=np.int64)
    for a in range(0, len(order), TOGETHER):
        new = order[a : a + TOGETHER]
        new = new[~dominated(points[new], points[held])]
        held = np.concatenate([held, new[~dominated(points[new], points[new])]])
    return np.sort(held)


def skyline(df: DataFrame, more: Sequence[str] = (), less: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` that none dominates: at least as good in all of ``more`` (larger) and ``less`` (smaller), and better in one.

    A task keeps the skyline of its own rows. What is left is cut into blocks along the
    first criterion; a block is compared with itself and the better ones, whose number
    grows with the skylines and not with the rows. Equal rows all stay; a row with a null
    or NaN in a criterion is beaten by none and beats none, and is left out. An empty
    table gives no rows.
    """
    criteria = [F.col(c).cast("double") for c in more] + [-F.col(c).cast("double") for c in less]
    whole = df.withColumn("sky_", F.array(*criteria)).filter(~F.exists("sky_", lambda x: x.isNull() | F.isnan(x)))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(rows):
                held = rows.iloc[local(np.stack(rows["sky_"].to_numpy()))]
        if held is not None:
            yield held

    left = materialize(whole.mapInPandas(keep, whole.schema))
    blocks = max(1, -(-left.count() // BLOCK))
    cut = left.repartitionByRange(blocks, F.element_at("sky_", 1).desc()).withColumn("block_", F.spark_partition_id())
    cut = materialize(cut.withColumn("own_", F.lit(True)))
    better = cut.withColumn("own_", F.lit(False)).withColumn("block_", F.explode(F.sequence(F.col("block_"), F.lit(blocks - 1)))).filter("block_ > 0")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, own = None, None
        for rows in batches:
            for (b, is_own), part in rows.groupby(["block_", "own_"], sort=False):
                points = np.stack(part["sky_"].to_numpy())
                if b != block:
                    if own is not None:
                        yield own
                    block, own = b, None
                if is_own:
                    own = part if own is None else pd.concat([own, part], ignore_index=True)
                    own = own.iloc[local(np.stack(own["sky_"].to_numpy()))]
                elif own is not None and len(own):
                    own = own[~dominated(np.stack(own["sky_"].to_numpy()), points)]
        if own is not None:
            yield own

    laid = cut.unionByName(better).repartition(blocks, "block_").sortWithinPartitions("block_", F.desc("own_"))
    return laid.mapInPandas(judge, laid.schema).select(*df.columns)
