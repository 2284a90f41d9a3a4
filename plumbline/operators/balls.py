"""Exact nearest neighbours that leave out what can't be near.

Base vectors belong to the nearest of some centres (those with the least hashes),
and a centre knows its farthest vector. A query first visits the balls nearest to it,
which bounds its k-th distance; by the triangle inequality a ball whose centre is
farther than that bound and its radius together holds none of the k, so the query is
sent to the others only. Results are those of the search of everything. Where vectors
have no clusters, bounds exclude little and all balls are visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .graph import least_hashed
from .knn import BATCH, BLOCK, _best, others, rough_squared_distances

#: Centres, at most: with their radii they are a parameter of the tasks.
CENTRES = 4096
#: Rows that a task sends on at a time.
SENT = 8192


class Visited(NamedTuple):
    """Pairs of a query and a base vector that were measured, and that there are."""

    pairs: int
    of: int


def _some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most ``BATCH`` rows at a time: a row meets all centres."""
    for rows in batches:
        for a in range(0, len(rows), BATCH):
            yield rows.iloc[a : a + BATCH]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(rough_squared_distances(x, centres), 0.0))


def _sent(rows: pd.DataFrame, q: np.ndarray, ball: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows for balls, ``SENT`` at a time: each carries its vector."""
    ids, vectors = rows["id"].to_numpy(), rows["vector"].to_numpy()
    for a in range(0, len(q), SENT):
        at = q[a : a + SENT]
        yield pd.DataFrame({"id": ids[at], "vector": vectors[at], "ball": ball[a : a + SENT]})


def _dealt(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _some(batches):
            d = _distances(np.stack(rows["vector"].to_numpy()), centres)
            ball = d.argmin(axis=1)
            yield pd.DataFrame({"ball": ball, "far": d[np.arange(len(ball)), ball], "id": rows["id"], "vector": rows["vector"]})

    return run


def _first(centres: np.ndarray, sizes: np.ndarray, k: int):
    """The nearest balls that hold ``k`` vectors together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _some(batches):
            order = _distances(np.stack(rows["vector"].to_numpy()), centres).argsort(axis=1, kind="stable")
            held = sizes[order].cumsum(axis=1)
            q, at = np.nonzero((held - sizes[order] < k) & (sizes[order] > 0))
            yield from _sent(rows, q, order[q, at])

    return run


def _rest(centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, k: int):
    """Balls that weren't visited first and that the bound doesn't exclude."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _some(batches):
            d = _distances(np.stack(rows["vector"].to_numpy()), centres)
            order = d.argsort(axis=1, kind="stable")
            held = sizes[order].cumsum(axis=1)
            seen = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(seen, order, held - sizes[order] < k, axis=1)
            bound = np.sqrt(rows["bound"].to_numpy())[:, None]
            slack = 1e-6 * (1 + d + bound + radii[None])  # roots of rounded sums
            q, ball = np.nonzero(~seen & (d - radii[None] <= bound + slack) & (sizes[None] > 0))
            yield from _sent(rows, q, ball)

    return run


def pruned_top_k(queries: DataFrame, base: DataFrame, k: int, same: bool = False, centres: int | None = None) -> tuple[DataFrame, Visited]:
    """``query_id, base_id, d, rk`` as of :func:`knn.exact_top_k`, and how many pairs were measured.

    There are as many centres as the root of the vectors' number, 4,096 at most. A large
    ball is cut into blocks. Fewer than ``k`` vectors are all found; no vectors give no rows.
    """
    want = k + 1 if same else k
    b = base.select(F.col("base_id").alias("id"), F.col("be").cast("array<double>").alias("vector"))
    n, asked = base.count(), materialize(queries.select(F.col("query_id").alias("id"), F.col("qe").cast("array<double>").alias("vector")))
    chosen = least_hashed(base, 3, min(CENTRES, centres or max(1, round(n**0.5))))
    points = {r["id"]: r["vector"] for r in b.filter(F.col("id").isin(chosen)).collect()}
    if not points:
        return base.sparkSession.createDataFrame([], "query_id long, base_id long, d double, rk int"), Visited(0, 0)
    middle = np.array([points[i] for i in chosen])
    balls = materialize(b.mapInPandas(_dealt(middle), "ball int, far double, id long, vector array<double>"))
    sizes, radii = np.zeros(len(middle), dtype=np.int64), np.zeros(len(middle))
    for r in balls.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        sizes[r["ball"]], radii[r["ball"]] = r["n"], r["far"]
    cuts = np.maximum(1, -(-sizes // BLOCK))  # blocks of each ball
    start = np.cumsum(cuts) - cuts
    listed = F.array(*[F.struct(F.lit(int(a)).alias("at"), F.lit(int(c)).alias("cuts")) for a, c in zip(start, cuts, strict=True)])
    of = F.element_at(listed, F.col("ball") + 1)
    dealt = balls.select((of["at"] + F.pmod(F.xxhash64("id"), of["cuts"])).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "vector")
    parts = max(1, -(-n // BLOCK), min(len(middle), 200))
    names = ["query_id", "base_id", "d"]

    def searched(visits: DataFrame) -> DataFrame:
        sent = visits.select(F.explode(F.sequence(of["at"], of["at"] + of["cuts"] - 1)).alias("block"), F.lit(1).alias("asks"), "id", "vector")
        laid = dealt.union(sent).repartition(parts, "block").sortWithinPartitions("block", "asks", "id")
        return laid.mapInPandas(_best(want, names, None), "query_id long, base_id long, d double")

    near = materialize(asked.mapInPandas(_first(middle, sizes, want), "id long, vector array<double>, ball int"))
    best = Window.partitionBy("query_id").orderBy("d", "base_id")
    found = materialize(searched(near).withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= want).drop("rk"))
    bound = found.groupBy("query_id").agg(F.max("d").alias("bound"))
    more = asked.join(bound, F.col("id") == F.col("query_id")).select("id", "vector", "bound").mapInPandas(_rest(middle, radii, sizes, want), "id long, vector array<double>, ball int")
    more = materialize(more)
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("ball") + 1).cast("long")
    measured = near.select("ball").union(more.select("ball")).agg(F.sum(weight)).first()[0] or 0
    whole = found.unionByName(searched(more)).withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= want)
    return (others(whole, k, "d") if same else whole), Visited(int(measured), n * asked.count())
