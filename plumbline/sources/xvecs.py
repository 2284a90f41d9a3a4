"""Vector files (records of a little-endian int32 length and as many values) and raw arrays.

``spark.read.format("xvecs")`` cuts a file, or all files of a folder in order of
their names, into ranges of whole records, so ids are positions without another
pass. ``kind`` is ``f`` (float32) or ``i`` (int32). A length that changes, a file
that ends within a record, a value that isn't finite, or a negative id in an
``i`` file is an error.

``spark.read.format("rawarray")`` does the same for arrays without lengths:
``kind`` is one of ``RAW``, and ``width`` says how many values a row has. Writers
refuse a folder that has files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range.
RANGE = 64 << 20
#: Raw element types and what a row's values are in Spark.
RAW = {"f32": ("<f4", "float"), "f64": ("<f8", "double"), "i32": ("<i4", "int"), "i64": ("<i8", "bigint"), "u8": ("<u1", "int"), "u32": ("<u4", "bigint")}


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, at


def pack(rows: np.ndarray, kind: str = "f") -> bytes:
    """Records of a matrix's rows."""
    values = np.asarray(rows).astype("<f4" if kind == "f" else "<i4")
    head = np.full((len(values), 1), values.shape[1], dtype="<i4").view(values.dtype)
    return np.hstack([head, values]).tobytes()


def unpack(raw: bytes, dim: int, kind: str = "f") -> np.ndarray:
    size = 4 * (dim + 1)
    if len(raw) % size:
        raise ValueError("the file ends within a record")
    table = np.frombuffer(raw, dtype="<i4").reshape(-1, dim + 1)
    if len(table) and (table[:, 0] != dim).any():
        raise ValueError("the length of vectors changes")
    values = table[:, 1:]
    if kind == "i" and (values < 0).any():
        raise ValueError("negative id")
    if kind == "f":
        values = values.view("<f4")
        if not np.isfinite(values).all():
            raise ValueError("a value isn't finite")
    return values


class _Range(InputPartition):
    def __init__(self, file: str = "", first: int = 0, count: int = 0, before: int = 0):
        self.file, self.first, self.count, self.before = file, first, count, before


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of a folder's files in order."""
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"nothing at {path}")
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.files = path, kind, _files(path)
        system, _ = _open(path)
        self.dim = 0
        for name, size in self.files:
            if size and not self.dim:
                with system.open_input_file(name) as file:
                    head = file.read(4)
                self.dim = int(np.frombuffer(head, "<i4")[0]) if len(head) == 4 else 0
            if size and (self.dim <= 0 or size % self.record):
                raise ValueError("the file ends within a record")

    @property
    def record(self) -> int:
        return 4 * (self.dim + 1)

    def rows(self, raw: bytes) -> np.ndarray:
        return unpack(raw, self.dim, self.kind)

    def partitions(self):
        step, before, out = max(1, RANGE // max(1, self.record)), 0, []
        for name, size in self.files:
            n = size // self.record if size else 0
            out += [_Range(name, a, min(step, n - a), before) for a in range(0, n, step)]
            before += n
        return out or [_Range()]

    def read(self, partition):
        if partition.count:
            system, _ = _open(self.path)
            with system.open_input_file(partition.file) as file:
                raw = file.read_at(partition.count * self.record, partition.first * self.record)
            for k, row in enumerate(self.rows(raw)):
                yield partition.before + partition.first + k, row.tolist()


class _RawReader(_Reader):
    def __init__(self, path: str, kind: str, width: int):
        self.path, self.kind, self.dim, self.files = path, RAW[kind][0], width, _files(path)
        if any(size % self.record for _, size in self.files):
            raise ValueError("the file ends within a row")

    @property
    def record(self) -> int:
        return self.dim * np.dtype(self.kind).itemsize

    def rows(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)


class XvecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xvecs"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{'float' if self.options.get('kind', 'f') == 'f' else 'int'}>"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("kind", "f"))


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawarray"

    def schema(self) -> str:
        return f"pos bigint, row array<{RAW[self.options['kind']][1]}>"

    def reader(self, schema):
        return _RawReader(self.options["path"], self.options["kind"], int(self.options.get("width", 1)))


def _write(df: DataFrame, order: str, column: str, folder: str, encode) -> int:
    """Tasks write ``column`` in ascending ``order``, a file a range; the number of rows.

    Files have names of their own until the job has succeeded, so a repeated task does no harm.
    """
    from pyarrow import fs

    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    if system.get_file_info(fs.FileSelector(at)):
        raise ValueError(f"{folder} isn't empty")

    def run(batches):
        part, name, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        system, at = _open(folder)
        with system.open_output_stream(f"{at}/{name}") as out:
            for rows in batches:
                if len(rows):
                    out.write(encode(np.stack(rows[column].to_numpy())))
                    n += len(rows)
        yield pd.DataFrame({"part": [part], "file": [name], "n": [n]})

    rows = df.select(order, column).repartitionByRange(order).sortWithinPartitions(order)
    done = rows.mapInPandas(run, "part int, file string, n long").collect()  # a row a range
    listed = {r["file"] for r in done}
    for info in system.get_file_info(fs.FileSelector(at)):
        if info.base_name not in listed:
            system.delete_file(info.path)
    for r in done:
        system.move(f"{at}/{r['file']}", f"{at}/part-{r['part']:06d}")
    return sum(r["n"] for r in done)


def write_xvecs(df: DataFrame, order: str, column: str, folder: str, kind: str = "f") -> int:
    return _write(df, order, column, folder, lambda rows: pack(rows, kind))


def write_raw(df: DataFrame, order: str, column: str, folder: str, kind: str) -> int:
    """``column`` holds arrays of equal length; values out of the type's range are an error."""
    dtype = np.dtype(RAW[kind][0])

    def encode(rows: np.ndarray) -> bytes:
        if dtype.kind in "iu" and len(rows) and (rows.min() < np.iinfo(dtype).min or rows.max() > np.iinfo(dtype).max):
            raise ValueError(f"a value is out of the range of {kind}")
        return rows.astype(dtype).tobytes()

    return _write(df, order, column, folder, encode)


def read_raw(spark: SparkSession, path: str, kind: str, width: int = 1, rows: int | None = None) -> DataFrame:
    """``pos, row``; ``rows`` is the size that is expected."""
    if rows is not None and sum(size for _, size in _files(path)) != rows * width * np.dtype(RAW[kind][0]).itemsize:
        raise ValueError(f"{path} hasn't {rows} rows")
    spark.dataSource.register(RawSource)
    return spark.read.format("rawarray").option("kind", kind).option("width", width).load(path)


def read_xvecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    spark.dataSource.register(XvecsSource)
    return spark.read.format("xvecs").option("kind", kind).load(path)


def check_dataset(base: DataFrame, queries: DataFrame, truth: DataFrame) -> None:
    """Raises unless lengths agree, a truth row belongs to each query, and its ids exist."""
    dims = {d for df in (base, queries) for (d,) in df.selectExpr("size(embedding)").distinct().limit(2).collect()}
    if len(dims) > 1:
        raise ValueError("base and query vectors differ in length")
    if queries.count() != truth.count():
        raise ValueError("as many rows of truth as queries are needed")
    if truth.selectExpr("max(array_max(embedding))").first()[0] >= base.count():
        raise ValueError("an id of the truth is out of range")
