"""Numbers by position: rows of equal width in files of the shared folder, of which a task reads those that it asks for.

A search along a graph asks for few rows, and only knows which when it has seen
others. With a join a round, all that rounds have found is shuffled again and again;
here a task reads rows as its searches come to them, a bounded number at a time, and
never has the graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize, shared_dir
from ..sources.xvecs import _open

#: Rows of a file, rows read in one piece at most, rows between two that are read along, and different rows looked up at a time.
FILE_ROWS, PIECE, ALONG, LOOKED = 1 << 16, 1 << 12, 3, 1 << 13


class Rows:
    """``take(at)``: rows at positions. Files are opened by the task that reads them."""

    def __init__(self, paths: list[str], kind: str, width: int, per_file: int):
        self.paths, self.kind, self.width, self.per_file, self.files = paths, kind, width, per_file, {}

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    def _file(self, n: int):
        if n not in self.files:
            system, at = _open(self.paths[n])
            self.files[n] = system.open_input_file(at)
        return self.files[n]

    def take(self, at: np.ndarray) -> np.ndarray:
        wanted, back = np.unique(at, return_inverse=True)
        size, out = np.dtype(self.kind).itemsize * self.width, np.empty((len(wanted), self.width), self.kind)
        for a in range(0, len(wanted), LOOKED):
            some = wanted[a : a + LOOKED]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (np.diff(some) > ALONG + 1) | (np.diff(some // min(PIECE, self.per_file)) > 0) | (np.diff(some // self.per_file) > 0)
            first = some[new]
            rows = some[np.append(np.flatnonzero(new)[1:], len(some)) - 1] - first + 1
            file, place = np.divmod(first, self.per_file)
            read = b"".join(self._file(f).read_at(n, p) for f, n, p in zip(file.tolist(), (rows * size).tolist(), (place * size).tolist(), strict=True))
            piece = np.cumsum(new) - 1
            out[a : a + LOOKED] = np.frombuffer(read, self.kind).reshape(-1, self.width)[(np.cumsum(rows) - rows)[piece] + some - first[piece]]
        return out[back.ravel()]


class Lists:
    """``take(at)``: lists of whole numbers at positions."""

    def __init__(self, heads: Rows, paths: list[str]):
        self.heads, self.values = heads, Rows(paths, "<i8", 1, 1)

    def take(self, at: np.ndarray) -> list[np.ndarray]:
        out = []
        for place, (first, n) in zip(at.tolist(), self.heads.take(at).tolist(), strict=True):
            out.append(np.frombuffer(self.values._file(place // self.heads.per_file).read_at(8 * n, 8 * first), "<i8"))
        return out


def positions(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """``df`` with ``at``, its rows' places in the order of ``by``, from 0; and the number of rows. A range is a task."""
    dealt = df.repartitionByRange(max(1, -(-df.count() // FILE_ROWS)), by).sortWithinPartitions(by)
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    sizes = dict(dealt.groupBy(part.alias("part")).count().collect())  # a row a range
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))])
    at = F.element_at(F.array(*[F.lit(int(x)) for x in before]).cast("array<long>"), part + 1) + F.col("at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("at", at), int(before[-1])


def _written(df: DataFrame, n: int, kind: str, width: int | None) -> list[tuple[str, str | None]]:
    """Files of ``df(at, value)``, in the order of positions; with ``width`` None lists of any length, and heads ``(first, length)``."""
    folder, per_file = shared_dir(df.sparkSession), FILE_ROWS
    files = -(-n // per_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        name, heads, done, values = uuid.uuid4().hex, None, 0, 0
        first, out = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("value")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            if out is None:
                first = batch.column("at")[0].as_py()
                out = system.open_output_stream(f"{at}/{name}")
                heads = system.open_output_stream(f"{at}/{name}-heads") if width is None else None
            if (batch.column("at").to_numpy() != np.arange(first + done, first + done + batch.num_rows)).any() or (width is not None and (sizes != width).any()):
                raise ValueError("rows are missing or differ in width")
            out.write(flat.tobytes())
            if heads is not None:
                heads.write(np.column_stack([values + np.cumsum(sizes) - sizes, sizes]).astype("<i8").tobytes())
            done, values = done + batch.num_rows, values + len(flat)
        if out is not None:
            out.close()
            if heads is not None:
                heads.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "rows": [done], "path": [f"{folder}/{name}"]})

    laid = df.select("at", "value").repartitionById(max(1, files), F.floor(F.col("at") / per_file).cast("int")).sortWithinPartitions("at")
    made = sorted(laid.mapInArrow(run, "first long, rows long, path string").collect())  # a row a file
    if [r["first"] for r in made] != list(range(0, n, per_file)) or sum(r["rows"] for r in made) != n:
        raise ValueError("positions aren't 0, 1, ...")
    return [(r["path"], f"{r['path']}-heads") for r in made]


def write_rows(df: DataFrame, n: int, kind: str, width: int) -> Rows:
    """``df(at, value)``, ``value`` a list of ``width`` numbers, as :class:`Rows`."""
    return Rows([path for path, _ in _written(df, n, kind, width)], kind, width, FILE_ROWS)


def write_lists(df: DataFrame, n: int) -> Lists:
    """``df(at, value)``, ``value`` a list of whole numbers, as :class:`Lists`."""
    made = _written(df, n, "<i8", None)
    return Lists(Rows([heads for _, heads in made], "<i8", 2, FILE_ROWS), [path for path, _ in made])


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)
