"""Residuals permuted within bins of exact rank, by hash order.

The candidates of a query come together once, in one row; a task draws all of its
permutations there and sends on what is counted of each. No row for a candidate, a
condition and a draw is ever made. A hash depends on the draw, the query and the
candidate only, so the orders of a query serve all its models and conditions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import shuffle_partitions

#: Bins of equal count of the condition by distance.
EQUAL = 4


def bins(n: int, edges: tuple[int, ...] | None) -> np.ndarray:
    """The bin of each exact rank from 1 to ``n``; without ``edges`` bins of equal count, the first ones larger by one where that can't be."""
    er = np.arange(1, n + 1)
    if edges is not None:
        return np.searchsorted(np.array(edges, dtype=np.int64), er, side="left")
    small, extra = divmod(n, EQUAL)
    return np.where(er <= extra * (small + 1), (er - 1) // (small + 1), extra + (er - 1 - extra * (small + 1)) // max(small, 1))


def hash_orders(query: int, ids: np.ndarray, draws: int) -> np.ndarray:
    """For each draw the places of ``ids`` in the order of MD5 ``7:draw:query:id``."""
    names = [b"%d" % i for i in ids.tolist()]
    md5 = hashlib.md5
    digests = b"".join([md5(head + name).digest() for head in (b"7:%d:%d:" % (k, query) for k in range(draws)) for name in names])
    key = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(draws, len(ids), 2)
    order = np.argsort(key[:, :, 0], axis=1, kind="stable")
    high = np.take_along_axis(key[:, :, 0], order, axis=1)
    return np.lexsort((key[:, :, 1], key[:, :, 0]), axis=-1) if (high[:, 1:] == high[:, :-1]).any() else order


def within(order: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    """The hash orders, bin by bin: entry k is the place whose residual goes to exact rank k + 1."""
    return np.take_along_axis(order, np.argsort(bin_of[order].astype(np.uint8), axis=1, kind="stable"), axis=1)


def _gathered(ranked: DataFrame) -> DataFrame:
    """A row a query: its candidates by model and exact rank, a list a column."""
    rows = ranked.select("query_id", F.struct("model", "er", "pos", "base_id", "exact", "score", "sr", "in_gt").alias("c"))
    dealt = rows.repartition(shuffle_partitions(ranked.sparkSession), "query_id")
    lists = dealt.groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return lists.select("query_id", *[F.col(f"c.{n}").alias(n) for n in ("model", "pos", "base_id", "exact", "score", "er", "sr", "in_gt")])


def _groups(batch: pa.RecordBatch):
    """``query, model, columns`` of every query and model of a batch."""
    query, lists = batch.column("query_id").to_pylist(), {n: batch.column(n) for n in batch.schema.names[1:]}
    at = lists["model"].offsets.to_numpy()
    flat = {n: x.values for n, x in lists.items()}
    model = np.array(flat.pop("model").to_pylist(), dtype=object)
    flat = {n: x.to_numpy(zero_copy_only=False) for n, x in flat.items()}
    for k, q in enumerate(query):
        names = model[at[k] : at[k + 1]]
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield q, names[a], {n: x[at[k] + a : at[k] + b] for n, x in flat.items()}


def _counted(top: int, edges: dict[str, tuple[int, ...] | None], draws: int):
    conditions = list(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, model, losses, moved, known = [], [], [], [], (None, None, None)
            for q, name, c in _groups(batch):
                ids, n = c["base_id"], len(c["base_id"])
                if known[0] != q or not np.array_equal(known[1], ids):
                    known = (q, ids, hash_orders(q, ids, draws))
                by_pos, error = np.argsort(c["pos"], kind="stable"), c["score"] - c["exact"]
                drawn = np.stack([c["exact"] + error[within(known[2], bins(n, edges[x]))] for x in conditions])
                first = by_pos[np.argsort(drawn[:, :, by_pos], axis=2, kind="stable")[:, :, :top]]
                inside = c["er"] <= top
                losses.append((c["in_gt"][inside].sum() - c["in_gt"][first].sum(axis=2)).ravel())
                moved.append((inside.sum() - inside[first].sum(axis=2)).ravel())
                query.append(q)
                model.append(name)
            if query:
                each = len(conditions) * draws
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(query, dtype=np.int64), each)),
                        pa.array(model, pa.string()).take(pa.array(np.repeat(np.arange(len(model)), each))),
                        pa.array(conditions, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(len(conditions)), draws), len(model)))),
                        pa.array(np.tile(np.arange(draws, dtype=np.int64), len(model) * len(conditions))),
                        pa.array(np.concatenate(losses).astype(np.int64)),
                        pa.array(np.concatenate(moved).astype(np.int64)),
                    ],
                    names=["query_id", "model", "condition", "draw", "loss_hits", "displaced"],
                )

    return run


def counted(ranked: DataFrame, top: int, edges: dict[str, tuple[int, ...] | None], draws: int) -> DataFrame:
    """``query_id, model, condition, draw, loss_hits, displaced`` of every draw.

    ``edges`` has the ranks after which a condition's bins end; None: bins of equal count.
    """
    return _gathered(ranked).mapInArrow(_counted(top, edges, draws), "query_id long, model string, condition string, draw long, loss_hits long, displaced long")


def _moved(top: int, draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, ids, errors = [], [], []
            for q, _, c in _groups(batch):
                crossed = np.flatnonzero((c["er"] <= top) != (c["sr"] <= top))
                if len(crossed):
                    error = c["score"] - c["exact"]
                    query.append(np.full(draws * len(crossed), q))
                    ids.append(np.tile(c["base_id"][crossed], draws))
                    errors.append(error[hash_orders(q, c["base_id"], draws)[:, crossed]].ravel())
            if query:
                draw = [np.repeat(np.arange(draws), len(i) // draws) for i in ids]
                columns = [pa.array(np.concatenate(x).astype(t)) for x, t in ((query, np.int64), (draw, np.int64), (ids, np.int64), (errors, np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "draw", "base_id", "e"])

    return run


def moved(ranked: DataFrame, top: int, draws: int) -> DataFrame:
    """``query_id, draw, base_id, e``: what unconditioned draws give the candidates that scores take across the boundary."""
    return _gathered(ranked).mapInArrow(_moved(top, draws), "query_id long, draw long, base_id long, e double")
