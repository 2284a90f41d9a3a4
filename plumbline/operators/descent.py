"""Neighbour graphs by descent: neighbours of neighbours are likely neighbours.

Lists of a bounded length are begun from leaves (rows next to one another along
random directions) and improved in rounds. In a round every vector introduces those
on its list, and a bounded number of those that have it on theirs, to each other;
only pairs with a newcomer are measured. What is nearer than the worst on a list
goes there. Rounds end when hardly any list changes. A round measures at most
``(2 * degree)**2 / 2`` pairs a vector, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed
from ..functions.storage import materialize
from .graph import _narrow

#: Directions by which lists are begun, and vectors of a leaf.
DIRECTIONS, LEAF = 4, 64
#: Candidates that a vector takes from one introduction.
TAKEN = 6
#: Groups whose distances are measured at a time.
TOGETHER = 64


class Report(NamedTuple):
    """What a build did: rounds, pairs measured in the leaves and in each round, changes of each round."""

    rounds: int
    leaf_pairs: int
    pairs: list[int]
    changes: list[int]


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Whole groups of rows that come sorted, some at a time."""
    left = None
    for rows in batches:
        rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
        if not len(rows):
            continue
        key = rows[by].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        left = rows.iloc[starts[-1] :]
        whole = [rows.iloc[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for k in range(0, len(whole), TOGETHER):
            yield whole[k : k + TOGETHER]
    if left is not None and len(left):
        yield [left]


def _measured(group: pd.DataFrame) -> np.ndarray:
    """Squared distances of a group's vectors; infinite to themselves."""
    x = np.stack(group["vector"].to_numpy()).astype(np.float64)
    n = (x * x).sum(axis=1)
    d = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0.0)
    np.fill_diagonal(d, np.inf)
    return d


def _leaves(degree: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _groups(batches, ["t", "leaf"]):
            out = []
            for group in groups:
                if len(group) < 2:
                    continue
                ids, d = group["id"].to_numpy(), _measured(group)
                k = min(degree, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), k)
                out.append(pd.DataFrame({"src": ids[rows], "dst": ids[near.ravel()], "d": d[rows, near.ravel()]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _introduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each group the pairs with a newcomer that are nearer than the worst on a list."""
    for groups in _groups(batches, ["v"]):
        out = []
        for group in groups:
            fresh = group["fresh"].to_numpy()
            if len(group) < 2 or not fresh.any():
                continue
            ids, worst, d = group["id"].to_numpy(), group["worst"].to_numpy(), _measured(group)
            d[~fresh[:, None] & ~fresh[None, :]] = np.inf
            k = min(TAKEN, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), k)
            cols = near.ravel()
            good = d[rows, cols] < worst[rows]
            out.append(pd.DataFrame({"src": ids[rows[good]], "dst": ids[cols[good]], "d": d[rows[good], cols[good]]}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _directions(dims: int):
    turn = np.random.default_rng(17).standard_normal((dims, DIRECTIONS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                along = np.stack(rows["vector"].to_numpy()) @ turn
                yield pd.DataFrame({"id": np.tile(rows["id"], DIRECTIONS), "t": np.repeat(np.arange(DIRECTIONS), len(rows)), "along": along.T.ravel()})

    return run


def _best(rows: DataFrame, degree: int) -> DataFrame:
    """The nearest of each list, a vector once: as an old acquaintance if it is one."""
    once = rows.groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    by = Window.partitionBy("src").orderBy("d", "dst")
    return once.withColumn("rk", F.row_number().over(by)).filter(F.col("rk") <= degree)


def build(base: DataFrame, degree: int, limit: int = 15, least_change: float = 0.002) -> tuple[DataFrame, Report]:
    """``src, dst, rk`` of ``base(base_id, be)``, and what it took.

    It ends when a round changes less than ``least_change`` of all places on lists.
    Fewer than ``degree`` vectors give shorter lists; one vector has none.
    """
    vectors = materialize(_narrow(base.select(F.col("base_id").alias("id"), F.col("be").cast("array<double>").alias("vector")), "vector"))
    first, n = vectors.select(F.size("vector")).first(), vectors.count()
    if first is None:
        return base.sparkSession.createDataFrame([], "src long, dst long, rk int"), Report(0, 0, [], [])
    keys = vectors.mapInPandas(_directions(first[0]), "id long, t int, along double")
    leaf = placed(keys, ["along"], ["id"], ["t"]).select("id", "t", F.floor((F.col("r_") - 1) / LEAF).alias("leaf"))
    laid = leaf.join(vectors, "id").repartition("t", "leaf").sortWithinPartitions("t", "leaf")
    begun = laid.mapInPandas(_leaves(degree), "src long, dst long, d double")
    lists = materialize(_best(begun.withColumn("fresh", F.lit(True)), degree))
    pairs, changes = [], []
    while len(changes) < limit:
        # those on the list, and as many of those that have it on theirs
        back = lists.select(F.col("dst").alias("v"), F.col("src").alias("id"), "fresh")
        some = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("v", "id", F.lit(len(changes))))
        back = back.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= degree).drop("r")
        members = lists.select(F.col("src").alias("v"), F.col("dst").alias("id"), "fresh").unionByName(back).repartition("v").groupBy("v", "id").agg(F.max("fresh").alias("fresh"))
        # where nobody is new nothing is measured, so no vectors are sent there
        members = materialize(members.withColumn("any", F.max("fresh").over(Window.partitionBy("v"))).filter("any").drop("any"))
        sizes = members.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("fresh")).cast("long")).alias("old"))
        pairs.append(int(sizes.agg(F.sum((F.col("n") * (F.col("n") - 1) - F.col("old") * (F.col("old") - 1)) / 2)).first()[0] or 0))
        worst = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) < degree, F.lit(float("inf"))).otherwise(F.max("d")).alias("worst"))
        known = vectors.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        laid = members.join(known, "id").repartition("v").sortWithinPartitions("v")
        found = laid.mapInPandas(_introduced, "src long, dst long, d double")
        lists = materialize(_best(lists.select("src", "dst", "d").withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), degree))
        changes.append(lists.filter("fresh").count())
        if changes[-1] <= least_change * n * degree:
            break
    per_leaf = DIRECTIONS * (n // LEAF * (LEAF * (LEAF - 1) // 2) + (n % LEAF) * (n % LEAF - 1) // 2)
    return lists.select("src", "dst", "rk"), Report(len(changes), per_leaf, pairs, changes)
