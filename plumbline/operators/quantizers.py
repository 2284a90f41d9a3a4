"""Product quantization: codebooks, codes, asymmetric distances, decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.storage import bound_batches, broadcast_if_small, materialize
from .knn import BLOCK, blocked_top_k


def sub_vectors(base: DataFrame, parts: int, dims: int) -> DataFrame:
    """``base_id, m, s``: a row for each sub-vector."""
    width = dims // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: F.struct(m.cast("long").alias("m"), F.slice("be", m * width + 1, width).alias("s")))
    return base.select("base_id", F.inline(cut))


def first_codebook(base: DataFrame, parts: int, codes: int, dims: int) -> DataFrame:
    """``m, c, centroid``: the sub-vectors of the base vectors with the least ids."""
    first = base.orderBy("base_id").limit(codes).withColumn("c", F.row_number().over(Window.orderBy("base_id")).cast("long") - 1)
    return sub_vectors(first.select("base_id", "be"), parts, dims).join(first.select("base_id", "c"), "base_id").select("m", "c", F.col("s").alias("centroid"))


#: Candidates scored at a time.
SCORED = 2048
#: Coded vectors of a block, which sends ``k`` rows a query, and tasks that share blocks if there are fewer of those.
CODED, TASKS = 32_768, 48
#: Training vectors for each centroid; more are left out, in the order of a hash of the id.
PER_CODE = 256


class Model(NamedTuple):
    """A product quantizer of a family: sub-spaces, seed of its start, training subset (None: all), rotation (0: none)."""

    name: str
    parts: int
    seed: int = 11
    subset: int | None = None
    turn: int = 0


def hash_key(*parts) -> Column:
    """MD5 of the parts joined by colons, as text."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def turn_signs(dims: int, turn: int) -> list[int]:
    """0 or 1 a dimension: which coordinates change their sign before the transform."""
    return [int(hashlib.md5(f"turn:{turn}:{j}".encode()).hexdigest(), 16) & 1 for j in range(dims)]


def turn_matrix(dims: int, turn: int) -> np.ndarray:
    """A rotation: signs by hash, then the Hadamard transform. ``dims`` is a power of two."""
    if dims & (dims - 1):
        raise ValueError("a rotated model needs a power of two dimensions")
    i = np.arange(dims)
    odd = (np.bitwise_count(i[:, None] & i[None, :]) + np.array(turn_signs(dims, turn))[None, :]) & 1
    return np.where(odd, -1.0, 1.0)


def turned(x: np.ndarray, turn: int) -> np.ndarray:
    """Rows rotated; sums run from the first dimension to the last."""
    if not turn:
        return x
    matrix, out = turn_matrix(x.shape[1], turn), np.zeros_like(x)
    for j in range(x.shape[1]):
        out += x[:, j, None] * matrix[None, :, j]
    return out / x.shape[1] ** 0.5


def _nearest(s: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; ties to the lower code."""
    d = np.zeros((len(s), len(centroids)))
    for j in range(s.shape[1]):
        t = s[:, j, None] - centroids[None, :, j]
        d += t * t
    return d.argmin(axis=1)


def _cells(models: list[Model], books: dict[str, np.ndarray]):
    """Sums and counts by cell of what a task holds: a row a coordinate of a centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for rows in batches:
            if not len(rows):
                continue
            x, member, by_turn = np.stack(rows["be"].to_numpy()), np.stack(rows["member"].to_numpy()), {}
            for k, model in enumerate(models):
                if model.turn not in by_turn:
                    by_turn[model.turn] = turned(x, model.turn)
                own, book = by_turn[model.turn][member[:, k]], books[model.name]
                parts, codes, width = book.shape
                sums = total.setdefault(model.name, np.zeros((parts, codes, width + 1)))
                for m in range(parts):
                    s = own[:, m * width : (m + 1) * width]
                    near = _nearest(s, book[m])
                    for j in range(width):
                        sums[m, :, j] += np.bincount(near, weights=s[:, j], minlength=codes)
                    sums[m, :, width] += np.bincount(near, minlength=codes)
        for name, sums in total.items():
            m, c, j = (g.ravel() for g in np.indices(sums[:, :, :-1].shape))
            n = np.repeat(sums[:, :, -1].ravel(), sums.shape[2] - 1)
            yield pd.DataFrame({"model": name, "m": m, "c": c, "j": j, "total": sums[:, :, :-1].ravel(), "n": n.astype(np.int64)})[n > 0]

    return run


def fit(rows: DataFrame, models: list[Model], start: dict[str, np.ndarray], rounds: int) -> dict[str, np.ndarray]:
    """K-means of all models and sub-spaces at once, over ``rows(be, member)``.

    Tasks assign their rows and send on sums by cell; only the means (models * codes *
    dimensions numbers) come back. Means are kept to four decimals, so they don't
    depend on the order of a sum; an empty cell keeps its centroid. Once a round changes
    none, further ones wouldn't either.
    """
    books = {name: book.copy() for name, book in start.items()}
    for _ in range(rounds):
        cells = rows.mapInPandas(_cells(models, books), "model string, m int, c int, j int, total double, n long")
        means = cells.groupBy("model", "m", "c", "j").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("x")).toPandas()
        before, books = books, {name: book.copy() for name, book in books.items()}
        for name, part in means.groupby("model"):
            books[name][part["m"], part["c"], part["j"]] = part["x"]
        if all((books[name] == before[name]).all() for name in books):
            break
    return books


def _start(rows: list, model: Model, dims: int) -> np.ndarray:
    x = turned(np.array(rows, dtype=np.float64).reshape(len(rows), dims), model.turn)
    return x.reshape(len(rows), model.parts, dims // model.parts).transpose(1, 0, 2)


def book_table(spark: SparkSession, books: dict[str, np.ndarray]) -> DataFrame:
    """``model, m, c, centroid``."""
    rows = [(name, m, c, book[m, c].tolist()) for name, book in books.items() for m in range(book.shape[0]) for c in range(book.shape[1])]
    return spark.createDataFrame(rows, "model string, m long, c long, centroid array<double>")


def books_of(table: DataFrame) -> dict[str, np.ndarray]:
    """The same the other way; a family's books are bounded by its parameters."""
    out: dict[str, dict] = {}
    for r in table.collect():
        out.setdefault(r["model"], {})[r["m"], r["c"]] = r["centroid"]
    return {name: np.array([[of[m, c] for c in range(1 + max(c for _, c in of))] for m in range(1 + max(m for m, _ in of))]) for name, of in out.items()}


def train_codebook(base: DataFrame, parts: int, codes: int, dims: int, rounds: int = 25, per_code: int = PER_CODE) -> DataFrame:
    """``m, c, centroid``: k-means in every subspace, a fixed number of rounds.

    It is fitted on the ``codes * per_code`` vectors with the least MD5 of their
    ids; the first ``codes`` of them are the first centroids.
    """
    spark, model = base.sparkSession, Model("pq", parts)
    sample = base.select("base_id", "be", hash_key(11, F.col("base_id")).alias("k")).orderBy("k", "base_id").limit(codes * per_code)
    rows = materialize(sample.select("be", F.array(F.lit(True)).alias("member"), "k", "base_id"))
    first = [r["be"] for r in rows.orderBy("k", "base_id").limit(codes).collect()]
    if not first:
        return spark.createDataFrame([], "m long, c long, centroid array<double>")
    return book_table(spark, fit(rows, [model], {"pq": _start(first, model, dims)}, rounds)).drop("model")


#: Hashes of a subset's members are below this: a third of all.
THIRD = "5" * 32


def train_models(base: DataFrame, models: list[Model], codes: int, dims: int, rounds: int, per_code: int = PER_CODE) -> DataFrame:
    """``model, m, c, centroid``: a family of product quantizers, trained together.

    Training vectors are a share of all by hash, ``codes * per_code`` on average if
    there are more; a model of a subset sees the third with the least hashes of its
    own. A model starts at the ``codes`` of its vectors that come first by its seed.
    """
    spark, n = base.sparkSession, base.count()
    share = min(1.0, codes * per_code / max(1, n))
    key = F.conv(F.substring(hash_key(11, F.col("base_id")), 1, 8), 16, 10).cast("double")
    member = F.array(*[F.lit(True) if m.subset is None else hash_key("subset", m.subset, F.col("base_id")) < THIRD for m in models])
    rows = materialize(base.filter(key < share * 2.0**32).select("base_id", "be", member.alias("member")))
    start, ready = {}, []
    asked = F.array(*[F.struct(F.lit(k).alias("k"), hash_key(m.seed, F.col("base_id")).alias("key")) for k, m in enumerate(models)])
    own = rows.select("base_id", "be", "member", F.explode(asked).alias("a")).filter(F.col("member")[F.col("a.k")])
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("a.k").orderBy("a.key", "base_id"))).filter(F.col("r") <= codes).select("a.k", "r", "be").collect()
    for k, model in enumerate(models):
        chosen = [r["be"] for r in sorted(first, key=lambda r: r["r"]) if r["k"] == k]
        if chosen:
            start[model.name] = _start(chosen, model, dims)
            ready.append(model)
    return book_table(spark, fit(rows, models, start, rounds)) if len(ready) == len(models) else book_table(spark, {})


def encode_models(base: DataFrame, models: list[Model], books: dict[str, np.ndarray]) -> DataFrame:
    """``base_id, model, codes``: every vector under every model."""
    bound_batches(base.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (whole.iloc[a : a + SCORED] for whole in batches for a in range(0, len(whole), SCORED)):
            x, by_turn = np.stack(rows["be"].to_numpy()), {}
            for model in models:
                if model.turn not in by_turn:
                    by_turn = {model.turn: turned(x, model.turn)}
                if len(rows):
                    book, own = books[model.name], by_turn[model.turn]
                    width = book.shape[2]
                    codes = np.stack([_nearest(own[:, m * width : (m + 1) * width], book[m]) for m in range(book.shape[0])], axis=1)
                    yield pd.DataFrame({"base_id": rows["base_id"], "model": model.name, "codes": list(codes)})

    return base.select("base_id", "be").mapInPandas(run, "base_id long, model string, codes array<long>")


def code_distances(q: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Distances of (rotated) queries to coded vectors, row by row: sums by sub-space, added up in order."""
    out, width = np.zeros(len(q)), book.shape[2]
    for m in range(book.shape[0]):
        near, part = book[m][codes[:, m]], np.zeros(len(q))
        for j in range(width):
            d = q[:, m * width + j] - near[:, j]
            part += d * d
        out += part
    return out


def lookup_tables(queries: DataFrame, models: list[Model], books: dict[str, np.ndarray]) -> DataFrame:
    """``query_id, luts``: a map of a model's distances to all its centroids, flat by sub-space and code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["qe"].to_numpy()) if len(rows) else None
            luts = [{} for _ in range(len(rows))]
            for model in models if len(rows) else []:
                book, q = books[model.name], turned(x, model.turn)
                width, flat = book.shape[2], []
                for m in range(book.shape[0]):
                    d = np.zeros((len(q), book.shape[1]))
                    for j in range(width):
                        t = q[:, m * width + j, None] - book[m][None, :, j]
                        d += t * t
                    flat.append(d)
                flat = np.concatenate(flat, axis=1)
                for k, lut in enumerate(luts):
                    lut[model.name] = flat[k].tolist()
            yield pd.DataFrame({"query_id": rows["query_id"], "luts": luts})

    return queries.select("query_id", "qe").mapInPandas(run, "query_id long, luts map<string, array<double>>")


def encode(subs: DataFrame, codebook: DataFrame) -> DataFrame:
    """``base_id, m, c``: nearest centroid, ties to the lowest code.

    A codebook has ``parts * codes`` rows; they are gathered by ``m`` and joined
    once, so no row for a vector and a centroid is made.
    """
    book = codebook.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("c", "centroid"))).alias("book"))
    near = F.array_min(F.transform("book", lambda x: F.struct(V.squared_l2(F.col("s"), x["centroid"]).alias("d"), x["c"].alias("c"))))
    return subs.join(F.broadcast(book), "m").select("base_id", "m", near["c"].alias("c"))


def lloyd(subs: DataFrame, codebook: DataFrame, rounds: int) -> DataFrame:
    """Fixed rounds of k-means in every subspace; an empty cell keeps its centroid."""
    for _ in range(rounds):
        member = subs.join(encode(subs, codebook), ["base_id", "m"])
        means = member.select("m", "c", F.posexplode("s").alias("j", "x")).groupBy("m", "c", "j").agg(F.avg("x").alias("x"))
        found = means.groupBy("m", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("mean"))
        codebook = codebook.join(found, ["m", "c"], "left").select("m", "c", F.coalesce("mean", "centroid").alias("centroid"))
    return codebook


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """``base_id, decoded``: centroids in the order of ``m``."""
    rows = codes.join(broadcast_if_small(codebook, codebook.count()), ["m", "c"])
    return rows.groupBy("base_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("m", "centroid"))), lambda e: e["centroid"])).alias("decoded"))


def code_bytes(parts: int, bits: int) -> int:
    return (parts * bits + 7) // 8


def adc_top_k(queries: DataFrame, codes: DataFrame, codebook: DataFrame, k: int) -> DataFrame:
    """``query_id, base_id, adc, rk``: asymmetric distances by a table for each query.

    The codebook (``parts * codes`` centroids) is a parameter of the tasks.
    """
    book = sorted(codebook.collect(), key=lambda r: (r["m"], r["c"]))
    parts = max(r["m"] for r in book) + 1
    tables = [np.array([r["centroid"] for r in book if r["m"] == m], dtype=np.float64) for m in range(parts)]

    def distances(q: np.ndarray, coded: np.ndarray) -> np.ndarray:
        luts, at = [], 0
        for table in tables:
            lut = np.zeros((len(table), len(q)))
            for j in range(table.shape[1]):
                d = q[None, :, at + j] - table[:, j, None]
                lut += d * d
            luts.append(lut)
            at += table.shape[1]
        out = np.empty((len(q), len(coded)))
        for a in range(0, len(coded), SCORED):
            own = coded[a : a + SCORED].astype(np.int64)
            total = np.zeros((len(own), len(q)))
            for m, lut in enumerate(luts):
                total += lut.take(own[:, m], axis=0)  # an entry for all queries at once
            out[:, a : a + SCORED] = total.T
        return out

    q = queries.select(F.col("query_id").alias("id"), F.col("qe").alias("vector"))
    b = codes.groupBy("base_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "c"))), lambda e: e["c"].cast("double")).alias("vector")).withColumnRenamed("base_id", "id")
    n = codes.select("base_id").distinct().count()
    lanes = max(1, min(TASKS // max(1, -(-n // CODED)), -(-n // BLOCK)))
    return blocked_top_k(q, b, k, ("query_id", "base_id", "adc"), distances, CODED, lanes)


def score_pool(pool: DataFrame, queries: DataFrame, base: DataFrame, coded: DataFrame, models: list[Model], books: dict[str, np.ndarray], pooled: str | None = None) -> DataFrame:
    """``query_id, pos, base_id, exact, model, score`` of every candidate under every model.

    Scores are asymmetric distances to the vectors' codes. ``pooled`` names the model
    whose distances the pool has already, in ``adc``.
    """
    bound_batches(pool.sparkSession)
    # codes of all models in one list, by the models' names; joins merge, since small files may hold large rows
    listed = F.transform(F.sort_array(F.collect_list(F.struct("model", "codes"))), lambda e: e["codes"])
    codes = coded.groupBy("base_id").agg(F.flatten(listed).alias("codes"))
    rows = pool.join(base.select("base_id", "be").hint("merge"), "base_id").join(codes.hint("merge"), "base_id").join(queries.select("query_id", "qe").hint("merge"), "query_id")
    first, at = {}, 0
    for model in sorted(models):
        first[model.name], at = at, at + model.parts
    names = ["query_id", "pos", "base_id", "exact", "model", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), SCORED):
                rows = whole.slice(k, SCORED)
                q, x, coded_as = (rows.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in ("qe", "be", "codes"))
                exact = np.zeros(len(rows))
                for j in range(q.shape[1]):
                    d = q[:, j] - x[:, j]
                    exact += d * d
                out = [*(rows.column(c) for c in names[:3]), pa.array(exact)]
                if pooled:
                    yield pa.RecordBatch.from_arrays([*out, pa.array([pooled], pa.string()).take(pa.array(np.zeros(len(rows), dtype=np.int64))), rows.column("adc")], names=names)
                by_turn = {}
                for model in models:  # those of one rotation stand together
                    if model.turn not in by_turn:
                        by_turn = {model.turn: turned(q, model.turn)}
                    own = coded_as[:, first[model.name] : first[model.name] + model.parts]
                    score = code_distances(by_turn[model.turn], own, books[model.name])
                    yield pa.RecordBatch.from_arrays([*out, pa.array([model.name], pa.string()).take(pa.array(np.zeros(len(rows), dtype=np.int64))), pa.array(score)], names=names)

    return rows.select("query_id", "pos", "base_id", "adc", "qe", "be", "codes").mapInArrow(run, "query_id long, pos long, base_id long, exact double, model string, score double")


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; signs are fixed so that it is unique."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def rotate(vectors: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """``vectors`` with ``column`` multiplied by the transposed matrix (a parameter of the tasks)."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ matrix.T)) if len(x) else x

    return vectors.withColumn(column, F.pandas_udf(run, "array<double>")(F.col(column)))


def save_index(folder: str, **tables: DataFrame) -> None:
    """Codebooks, codes and graph edges as Parquet tables; existing ones are an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_index(spark, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
