"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Vectors are dealt into blocks. A block holds ``trees`` sorted arrays of 64-bit
hash strings (signs of random projections, longest prefix first). A query
descends every tree to the entries with the longest common prefix; then all
trees ascend together, a bit at a time, until the entries below hold
``candidates`` times the block's vectors, counted with repeats. Candidates get
their exact cosine, and the best of all blocks are merged. Every vector is in
every tree of its block, and every query goes to every block.

Hash strings do not depend on the data. On vectors without structure (64
independent dimensions, where the nearest of 50,000 has a cosine under 0.5) a
forest needs a good share of the vectors as candidates for a recall of 0.9, so
``candidates`` is a share and not a number. Entries are counted with repeats: the
default 0.6 makes about half of a block's vectors different candidates.

Defined results: vectors that are null, zero, or hold a null or non-finite
number take no part, nor do null ids and vectors of another length than the most
frequent one (of equally frequent ones, the longest); repeated rows count once,
and two different vectors with one id are two candidates, neither of them for
that id's queries; ties go to the smaller id; no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BLOCK, SEED = 64, 16_384, 11
#: Queries that a block answers at a time, and entries that are looked at in any case.
BATCH, LEAST = 256, 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def hash_strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """64 signs of each row, the first one in the highest bit."""
    return np.packbits(unit @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _prefix_masks(length: np.ndarray) -> np.ndarray:
    return np.where(length == 0, np.uint64(0), _ALL << ((np.uint64(64) - length.astype(np.uint64)) & np.uint64(63)))


class Forest:
    """Sorted hash strings of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((vectors.shape[1], 64)) for _ in range(trees)]
        strings = [hash_strings(unit, p) for p in self.planes]
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order, strict=True)]

    def _ranges(self, strings: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = _prefix_masks(length)
        low = np.stack([np.searchsorted(s, q & mask, "left") for s, q in zip(self.sorted, strings, strict=True)])
        high = np.stack([np.searchsorted(s, q & mask | ~mask, "right") for s, q in zip(self.sorted, strings, strict=True)])
        return low, high

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> list[tuple[int, int, float]]:
        """``(query_id, vec_id, score)`` of each query's best in this block."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        strings = [hash_strings(queries / norms[:, None], p) for p in self.planes]
        # an entry counts at most once a tree, so these are k + 2 different ones at least
        wanted = min(max(share * len(self.ids), LEAST, len(self.planes) * (k + 2)), len(self.planes) * len(self.ids))
        low, high = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), 64)
        while (low < high).any():  # the longest prefix length with enough below it in all trees
            middle = (low + high + 1) // 2
            a, b = self._ranges(strings, middle)
            enough = (b - a).sum(axis=0) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        first, last = self._ranges(strings, low)
        out, marked = [], np.zeros(len(self.ids), dtype=bool)
        for q in range(len(ids)):
            marked[:] = False
            for t, order in enumerate(self.order):
                marked[order[first[t, q] : last[t, q]]] = True
            at = np.flatnonzero(marked & (self.ids != ids[q]))
            if len(at) > 2 * k:
                rough = self.vectors[at] @ queries[q] / (self.norms[at] * norms[q])
                at = at[rough >= np.partition(rough, -k)[-k] - 1e-9]
            score = (self.vectors[at] * queries[q]).sum(axis=1) / (self.norms[at] * norms[q])
            best = np.lexsort((self.ids[at], -score))[:k]
            out += [(int(ids[q]), int(self.ids[at[i]]), float(score[i])) for i in best]
        return out


def _answer(k: int, trees: int, share: float):
    columns = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, parts, forest = None, [], [], None
        for rows in batches:
            for (b, asks), part in rows.groupby(["block", "asks"], sort=True):
                key, vectors = part["id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64)
                if b != block:
                    block, ids, parts, forest = b, [], [], None
                if not asks:
                    ids.append(key)
                    parts.append(vectors)
                elif ids:
                    forest = forest or Forest(np.concatenate(ids), np.concatenate(parts), trees)
                    for a in range(0, len(key), BATCH):
                        yield pd.DataFrame(forest.search(key[a : a + BATCH], vectors[a : a + BATCH], k, share), columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``id, vector`` (doubles) of the distinct rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    fine = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("vector", lambda x: x != 0))
    fine = materialize(fine.distinct())
    common = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.filter(F.size("vector") == (common["d"] if common else 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = TREES, candidates: float = 0.6, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` with ``is_query(id)``."""
    rows = valid_vectors(vectors)
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "vector")
    asked = rows.filter(is_query(F.col("id"))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "vector")
    laid = dealt.union(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "id")
    found = laid.mapInPandas(_answer(k, trees, candidates), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
