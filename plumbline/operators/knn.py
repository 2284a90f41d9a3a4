"""Exhaustive nearest neighbours, block by block.

Base vectors are dealt into blocks; every query goes to every block. A task
chooses by matrix products all that can be among the ``k`` best, adds up the
squared differences of those one dimension after the other (so sums are the same
as in SQL) and sends on its ``k`` best. No pair of a query and a base vector is
ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import bound_batches

#: Base vectors of a block, queries answered at a time at most, and their pairs with a block's vectors.
BLOCK, BATCH, PAIRS = 8192, 256, 1 << 19
#: The same of squared Euclidean distances, whose blocks meet queries tile by tile; tasks, and vectors for which a further block or lane is worth it.
NEAR, TASKS, WORTH = 1 << 16, 48, 2048
#: Pairs a query that the rough product may leave, as a multiple of ``k``.
LEFT = 32


def rough_squared_distances(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The same by one matrix product; not to the last bits."""
    out, products = (queries * queries).sum(axis=1)[:, None] + (base * base).sum(axis=1)[None, :], queries @ base.T
    products *= 2.0
    out -= products
    return out


def _pairs(queries: np.ndarray, base: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of single pairs, from the first dimension to the last."""
    out = np.zeros(len(q))
    for j in range(queries.shape[1]):
        d = queries[q, j] - base[b, j]
        out += d * d
    return out


def _chosen(k: int, d: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` least, with all within ``slack`` of the last."""
    last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    return np.nonzero(d <= last[:, None] + slack)


def _best(k: int, columns: list[str], distances: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
    """``distances`` None: squared Euclidean, a matrix product to choose and exact sums to rank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, parts, base = None, [], [], None
        for rows in batches:
            for (b, asks), part in rows.groupby(["block", "asks"], sort=True):
                key, vectors = part["id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64)
                if b != block:
                    block, ids, parts, base = b, [], [], None
                if not asks:
                    ids.append(key)
                    parts.append(vectors)
                elif ids:
                    if base is None:
                        base, known, parts = np.concatenate(parts), np.concatenate(ids), []
                        largest = float((base * base).sum(axis=1).max())
                    together = max(1, min(BATCH, PAIRS // len(base)))
                    for a in range(0, len(key), together):
                        asked = vectors[a : a + together]
                        if distances is None:
                            slack = 1e-9 * (largest + float((asked * asked).sum(axis=1).max()) + 1e-300)
                            q, at = _chosen(k, rough_squared_distances(asked, base), slack)
                            d = _pairs(asked, base, q, at)
                        else:
                            whole = distances(asked, base)
                            q, at = _chosen(k, whole, 0.0)
                            d = whole[q, at]
                        order = np.lexsort((known[at], d, q))
                        q, at, d = q[order], at[order], d[order]
                        first = np.searchsorted(q, np.arange(len(asked)))
                        keep = np.arange(len(q)) - first[q] < k
                        yield pd.DataFrame({columns[0]: key[a : a + together][q[keep]], columns[1]: known[at[keep]], columns[2]: d[keep]})

    return run


class _Block:
    """A block of base vectors, of which each query's ``k`` nearest are found: single precision chooses, exact sums rank."""

    def __init__(self, ids: np.ndarray, base: np.ndarray):
        self.ids, self.base, squares = ids, base, (base * base).sum(axis=1)
        self.largest = float(squares.max())
        self.usable = bool(np.isfinite(base).all()) and self.largest < 1e30
        # a query with a 1 behind it, times this: what it is away, but for its own square
        self.rough = np.concatenate([-2.0 * base, squares[:, None]], axis=1).astype(np.float32) if self.usable else None

    def _roughly(self, k: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All pairs that can be among the ``k`` nearest, or None if these are too many to hold."""
        n, m = len(self.base), len(asked)
        squares = float((asked * asked).sum(axis=1).max())
        if not self.usable or not squares < 1e30 or n <= k:
            return None
        # rounding of inputs and of the sum moves a product by half of it at most
        slack = np.float32(2.4e-7 * (asked.shape[1] + 8) * (self.largest + squares) + 1e-30)
        q32, wide = np.concatenate([asked, np.ones((m, 1))], axis=1).astype(np.float32), max(8 * k, PAIRS // m)
        bound, found, held, tiles = np.full(m, np.inf, dtype=np.float32), [], 0, 0
        for a in range(0, n, wide):
            d = q32 @ self.rough[a : a + wide].T
            if not tiles and d.shape[1] >= 8 * k:
                # the k-th least of groups' least is no less than the k-th least
                least = d[:, : d.shape[1] // 8 * 8].reshape(m, 8, -1).min(axis=1)
                bound = np.partition(least, k - 1, axis=1)[:, k - 1]
            at = np.flatnonzero(d <= (bound + slack)[:, None])
            held, tiles = held + len(at), tiles + 1
            if held > LEFT * k * m:
                return None
            row, col = np.divmod(at, d.shape[1])
            found.append((row, col + a, d.ravel()[at]))
            if not tiles & (tiles - 1) or a + wide >= n:
                row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((value, row))
                row, col, value = row[order], col[order], value[order]
                last = np.searchsorted(row, np.arange(m)) + k - 1
                enough = last < np.searchsorted(row, np.arange(m), side="right")
                bound[enough] = np.minimum(bound[enough], value[last[enough]])
                keep = value <= (bound + slack)[row]
                found = [(row[keep], col[keep], value[keep])]
                held = int(keep.sum())
        return found[0][:2]

    def nearest(self, k: int, key: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        chosen = self._roughly(k, asked)
        if chosen is not None:
            yield self._ranked(k, key, asked, *chosen)
            return
        slack = 1e-9 * (self.largest + float((asked * asked).sum(axis=1).max()) + 1e-300)
        together = max(1, PAIRS // len(self.base))
        for a in range(0, len(key), together):
            some = asked[a : a + together]
            yield self._ranked(k, key[a : a + together], some, *_chosen(k, rough_squared_distances(some, self.base), slack))

    def _ranked(self, k: int, key: np.ndarray, asked: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _pairs(asked, self.base, q, at)
        order = np.lexsort((self.ids[at], d, q))
        q, at, d = q[order], at[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(asked)))[q] < k
        return key[q[keep]], self.ids[at[keep]], d[keep]


def _near(k: int, columns: list[str]):
    """As ``_best``, over the rows of one block: its own come first."""

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("vector")
        width = np.unique(np.diff(lists.offsets.to_numpy()))
        if len(width) != 1:
            raise ValueError("vectors differ in length")
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, block = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            asks, key, x = batch.column("asks").to_numpy() == 1, batch.column("id").to_numpy(), vectors(batch)
            if not asks.all():
                ids.append(key[~asks])
                parts.append(x[~asks])
            if not asks.any() or not ids:
                continue
            if block is None:
                block, parts = _Block(np.concatenate(ids), np.concatenate(parts)), None
            key, x = key[asks], x[asks]
            for a in range(0, len(key), BATCH):
                for rows in block.nearest(k, key[a : a + BATCH], x[a : a + BATCH]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=columns)

    return run


def blocked_top_k(queries: DataFrame, base: DataFrame, k: int, names: tuple[str, str, str], distances=None, block: int | None = None, lanes: int | None = None) -> DataFrame:
    """``queries(id, vector)``, ``base(id, vector)`` -> names, and ``rk`` from 1; ties to the smaller id.

    ``lanes``: tasks that share a block's queries, each with the block's vectors.
    """
    bound_batches(base.sparkSession)
    n = base.count()
    blocks = max(1, -(-n // (block or (BLOCK if distances else NEAR))))
    if not distances and not block:
        # each block's results are sent as well as the query: about a fifth of a vector each
        asks = queries.count()
        blocks = max(blocks, min(n // WORTH, round((TASKS * n / (max(1, asks) * (1 + k / 5))) ** 0.5), TASKS))
        lanes = lanes or max(1, min(-(-TASKS // blocks), asks // WORTH))
    lanes = lanes or 1
    first = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int") * lanes
    lane = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(lanes)).cast("int")
    dealt = base.select(F.explode(F.sequence(first, first + (lanes - 1))).alias("block"), F.lit(0).alias("asks"), "id", "vector")
    asked = queries.select(F.explode(F.sequence(lane, lane + (blocks - 1) * lanes, F.lit(lanes))).alias("block"), F.lit(1).alias("asks"), "id", "vector")
    laid = dealt.union(asked).repartitionById(blocks * lanes, F.col("block")).sortWithinPartitions("block", "asks", "id")
    columns = f"{names[0]} long, {names[1]} long, {names[2]} double"
    found = laid.mapInPandas(_best(k, list(names), distances), columns) if distances else laid.mapInArrow(_near(k, list(names)), columns)
    best = Window.partitionBy(names[0]).orderBy(names[2], names[1])
    return found.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def others(found: DataFrame, k: int, by: str) -> DataFrame:
    """The ``k`` nearest without a query's own row, from ``k + 1`` that may hold it."""
    best = Window.partitionBy("query_id").orderBy(by, "base_id")
    return found.filter("query_id <> base_id").withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def exact_top_k(queries: DataFrame, base: DataFrame, k: int, same: bool = False) -> DataFrame:
    """Ground truth ``query_id, base_id, d, rk`` by squared Euclidean distance.

    ``same``: queries are rows of ``base``, and a query's own row is no neighbour.
    """
    q = queries.select(F.col("query_id").alias("id"), F.col("qe").alias("vector"))
    b = base.select(F.col("base_id").alias("id"), F.col("be").alias("vector"))
    names = ("query_id", "base_id", "d")
    return others(blocked_top_k(q, b, k + 1, names), k, "d") if same else blocked_top_k(q, b, k, names)


def identity_distances(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Squared distances by the norm identity, to 9 places, so that copies tie."""
    return np.round(rough_squared_distances(queries, base), 9)


def _within(batches: Iterator[pd.DataFrame], same: bool = False) -> Iterator[pd.DataFrame]:
    block, ids, parts, base = None, [], [], None
    for rows in batches:
        for (b, asks), part in rows.groupby(["block", "asks"], sort=True):
            vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
            if b != block:
                block, ids, parts, base = b, [], [], None
            if not asks:
                ids.append(part["id"].to_numpy())
                parts.append(vectors)
            elif parts:
                if base is None:
                    base, known = np.concatenate(parts), np.concatenate(ids)
                    largest = float((base * base).sum(axis=1).max())
                key, bound = part["id"].to_numpy(), part["bound"].to_numpy()
                together = max(1, min(BATCH, PAIRS // len(base)))
                for a in range(0, len(key), together):
                    asked, d10 = vectors[a : a + together], bound[a : a + together]
                    slack = 1e-9 * (largest + float((asked * asked).sum(axis=1).max()) + 1e-300)
                    rough = rough_squared_distances(asked, base) - d10[:, None]
                    if same:
                        rough[known[None, :] == key[a : a + together, None]] = np.inf
                    closer = (rough < -slack).sum(axis=1)
                    q, at = np.nonzero(np.abs(rough) <= slack)
                    d = _pairs(asked, base, q, at)
                    closer += np.bincount(q[d < d10[q]], minlength=len(asked))
                    tied = np.bincount(q[d == d10[q]], minlength=len(asked))
                    yield pd.DataFrame({"query_id": key[a : a + together], "bound": d10, "closer": closer, "tied": tied})


def count_within(queries: DataFrame, base: DataFrame, block: int = BLOCK, same: bool = False) -> DataFrame:
    """``queries(id, vector, bound)``, ``base(id, vector)`` -> ``query_id, bound, closer, tied`` over all of ``base``, or all but the own row."""
    blocks = max(1, -(-base.count() // block))
    dealt = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "vector", F.lit(None).cast("double").alias("bound"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "vector", "bound")
    laid = dealt.union(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    found = laid.mapInPandas(lambda batches: _within(batches, same), "query_id long, bound double, closer long, tied long")
    return found.groupBy("query_id", "bound").agg(F.sum("closer").alias("closer"), F.sum("tied").alias("tied"))
