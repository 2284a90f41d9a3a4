"""Queries as a stream: search, gap, refinement and final order by micro-batch.

The pool of scored candidates is static. A micro-batch takes ``files`` new files
of query ids, keeps the best 16 by score, refines those queries whose gap is at
most ``tau`` by the exact order, and appends ten rows a query. A batch is written
below its number, so one that is run again replaces its own output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def refine(queries: DataFrame, scored: DataFrame, tau: float, k: int = 10, depth: int = 16) -> DataFrame:
    """``query_id, rank, base_id, refined`` for ``queries(query_id)``; ``scored`` has one model."""
    by_score = Window.partitionBy("query_id").orderBy("score", "pos")
    near = scored.join(queries.select("query_id").distinct(), "query_id").withColumn("sr", F.row_number().over(by_score)).filter(F.col("sr") <= depth)
    whole = Window.partitionBy("query_id")
    pick = lambda r: F.max(F.when(F.col("sr") == r, F.col("score"))).over(whole)
    gap = F.coalesce(pick(k + 2) - pick(k - 1), F.lit(float("inf")))
    final = Window.partitionBy("query_id").orderBy(F.when(F.col("refined"), F.col("exact")).otherwise(F.col("score")), "pos")
    return near.withColumn("refined", gap <= tau).withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "base_id", "refined")


def refine_stream(spark: SparkSession, folder: str, scored: DataFrame, tau: float, out: str, state: str, files: int = 1) -> None:
    """Runs until all files in ``folder`` (Parquet with ``query_id``) are done."""

    def each(batch: DataFrame, number: int) -> None:
        refine(batch, scored, tau).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema("query_id long").option("maxFilesPerTrigger", files).parquet(folder)
    run = source.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def refine_one(exact: np.ndarray, score: np.ndarray, tau: float, k: int = 10, depth: int = 16) -> tuple[np.ndarray, bool]:
    """Places of the ``k`` answers of one query, and whether it was refined: the scalar path."""
    order = sorted(range(len(score)), key=lambda p: (score[p], p))[:depth]
    gap = score[order[k + 1]] - score[order[k - 2]] if len(order) > k + 1 else float("inf")
    refined = bool(gap <= tau)
    return np.array(sorted(order, key=lambda p: (exact[p], p))[:k] if refined else order[:k]), refined


class Worker:
    """Answers queries in the order of arrival, ``batch`` of them deferred and refined together.

    Score and place arrays are kept and filled again for every batch; ``epoch``
    counts the batches, and tags the rows that are of the present one.
    """

    def __init__(self, tau: float, k: int = 10, depth: int = 16, batch: int = 32):
        self.tau, self.k, self.depth, self.batch, self.epoch = tau, k, depth, batch, 0
        self.places, self.scores, self.exact = (np.zeros((batch, depth), dtype=t) for t in (np.int64, np.float64, np.float64))
        self.tag, self.waiting = np.full(batch, -1), []

    def take(self, query: int, ids: np.ndarray, exact: np.ndarray, score: np.ndarray):
        slot = len(self.waiting)
        best = np.lexsort((np.arange(len(score)), score))[: self.depth]
        self.places[slot], self.scores[slot], self.exact[slot] = len(score), np.inf, np.inf
        self.places[slot, : len(best)], self.scores[slot, : len(best)], self.exact[slot, : len(best)] = best, score[best], exact[best]
        self.tag[slot] = self.epoch
        self.waiting.append((query, ids, exact, score))
        return self.answer() if len(self.waiting) == self.batch else []

    def answer(self) -> list[tuple[int, int, int, int, bool, bool]]:
        """``query, batch, rank, id, refined, same`` of what waits; ``same``: the scalar path agrees."""
        now = self.tag == self.epoch
        gap = np.full(int(now.sum()), np.inf)
        if self.depth > self.k + 1:
            near, far = self.scores[now, self.k - 2], self.scores[now, self.k + 1]
            known = np.isfinite(far)  # pools of fewer are refined by no gap
            gap[known] = far[known] - near[known]
        near = gap <= self.tau
        order = np.lexsort((self.places[now], np.where(near[:, None], self.exact[now], self.scores[now])), axis=1)
        final, out = np.take_along_axis(self.places[now], order, axis=1)[:, : self.k], []
        for row, refined, (query, ids, exact, score) in zip(final, near, self.waiting, strict=True):
            row = row[row < len(score)]
            alone, alone_refined = refine_one(exact, score, self.tau, self.k, self.depth)
            same = alone_refined == refined and alone.tolist() == row.tolist()
            out += [(query, self.epoch, r, int(ids[p]), bool(refined), same) for r, p in enumerate(row, 1)]
        self.waiting, self.epoch = [], self.epoch + 1
        return out


def serve(queries: DataFrame, scored: DataFrame, tau: float, workers: int = 4, batch: int = 32) -> DataFrame:
    """``query_id, worker, batch, rank, base_id, refined, same``: a query goes to worker ``number % workers``.

    ``queries(query_id, number)``; a worker is a task that starts when its rows are there, and sees its queries in order of number.
    """

    def run(batches):
        worker, who, state, left = None, None, None, None

        def rows_of(out):
            return pd.DataFrame([(q, who, *x) for q, *x in out], columns=["query_id", "worker", "batch", "rank", "base_id", "refined", "same"])

        def answered(rows: pd.DataFrame):
            nonlocal who, state
            for (w, _, q), part in rows.groupby(["worker", "number", "query_id"], sort=True):
                if w != who:
                    if state is not None and state.waiting:
                        yield rows_of(state.answer())
                    who, state = w, Worker(tau, batch=batch)
                out = state.take(q, part["base_id"].to_numpy(), part["exact"].to_numpy(), part["score"].to_numpy())
                if out:
                    yield rows_of(out)

        for rows in batches:
            rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
            if len(rows):
                last = (rows["worker"] == rows["worker"].iloc[-1]) & (rows["query_id"] == rows["query_id"].iloc[-1])
                left = rows[last]
                yield from answered(rows[~last])
        if left is not None and len(left):
            yield from answered(left)
        if state is not None and state.waiting:
            yield rows_of(state.answer())

    dealt = scored.select("query_id", "pos", "base_id", "exact", "score").join(queries.select("query_id", "number"), "query_id").withColumn("worker", (F.col("number") % workers).cast("int"))
    laid = dealt.repartitionById(workers, F.col("worker")).sortWithinPartitions("worker", "number", "pos")
    return laid.mapInPandas(run, "query_id long, worker long, batch long, rank long, base_id long, refined boolean, same boolean")


def monitor(answers: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Share of refined queries by time window over a stream with an event time ``ts``."""
    return answers.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("answers"), F.avg(F.col("refined").cast("double")).alias("refined_share"))
