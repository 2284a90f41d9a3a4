"""Arrow IPC files and streams of vectors, read by ranges of record batches.

``spark.read.format("arrowipc")`` takes a file, or all files of a folder in order of
their names. Planning reads the headers of messages only: each says how long its
body is and how many rows it has, so bodies are skipped, ranges are of whole batches,
and a row knows its place in its shard without another pass. Tasks read their
batches and take two columns from them (``column`` and, if given, ``key``).

Options: ``path``; ``column``, a list column of floats or doubles; ``key``, a column
of whole numbers; ``dimension``, the length that every vector must have; ``rows``, the
number of rows that there must be. A null vector or component, a component that
isn't finite, another length or another number of rows is an error. Dictionaries and
compressed bodies of batches work as far as Arrow reads a batch by itself: a
dictionary-encoded key isn't supported.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .xvecs import RANGE, _files, _open

#: Fixed values of the format: the mark before a message's length, a file's first bytes, and the number of a record batch among headers.
CONTINUATION, MAGIC, RECORD_BATCH = b"\xff\xff\xff\xff", b"ARROW1\x00\x00", 3


def _field(table: bytes, at: int, k: int) -> int:
    """The place of a flat table's k-th field; 0 where it is absent."""
    v = at - struct.unpack_from("<i", table, at)[0]
    inside = struct.unpack_from("<H", table, v)[0]
    offset = struct.unpack_from("<H", table, v + 4 + 2 * k)[0] if 4 + 2 * k < inside else 0
    return at + offset if offset else 0


def _header(meta: bytes) -> tuple[int, int, int]:
    """Kind of a message, length of its body, and rows of a record batch."""
    at = struct.unpack_from("<I", meta, 0)[0]
    kind, body, inner = _field(meta, at, 1), _field(meta, at, 3), _field(meta, at, 2)
    kind = meta[kind] if kind else 0
    rows = 0
    if kind == RECORD_BATCH and inner:
        batch = inner + struct.unpack_from("<I", meta, inner)[0]
        n = _field(meta, batch, 0)
        rows = struct.unpack_from("<q", meta, n)[0] if n else 0
    return kind, struct.unpack_from("<q", meta, body)[0] if body else 0, rows


def batches_of(file, size: int) -> list[tuple[int, int, int]]:
    """``offset, bytes, rows`` of each record batch of a file or stream."""
    at, out = (len(MAGIC) if file.read_at(len(MAGIC), 0) == MAGIC else 0), []
    while at + 8 <= size:
        mark, length = file.read_at(4, at), struct.unpack("<i", file.read_at(4, at + 4))[0]
        if mark != CONTINUATION:
            raise ValueError("no message where one should begin")
        if not length:
            break  # end of the stream
        meta = file.read_at(length, at + 8)
        if len(meta) < length:
            raise ValueError("the file ends within a message")
        kind, body, rows = _header(meta)
        if at + 8 + length + body > size:
            raise ValueError("the file ends within a message")
        if kind == RECORD_BATCH:
            out.append((at, 8 + length + body, rows))
        at += 8 + length + body
    return out


def _schema(file) -> pa.Schema:
    head = file.read_at(8, 0)
    file.seek(len(MAGIC) if head == MAGIC else 0)
    return pa.ipc.read_schema(file)


class _Batches(InputPartition):
    def __init__(self, file: str = "", shard: str = "", parts: list | None = None, before: int = 0):
        self.file, self.shard, self.parts, self.before = file, shard, parts or [], before


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.column, self.key = options["path"], options["column"], options.get("key")
        self.dim = int(options["dimension"]) if "dimension" in options else None
        self.want = int(options["rows"]) if "rows" in options else None

    def partitions(self):
        system, _ = _open(self.path)
        out, total = [], 0
        for name, size in _files(self.path):
            with system.open_input_file(name) as file:
                found = batches_of(file, size)
            parts, length, before, first = [], 0, 0, 0
            for offset, n_bytes, rows in found:
                if parts and length + n_bytes > RANGE:
                    out.append(_Batches(name, name.rsplit("/", 1)[-1], parts, first))
                    parts, length, first = [], 0, before
                parts.append((offset, n_bytes))
                length, before = length + n_bytes, before + rows
            if parts:
                out.append(_Batches(name, name.rsplit("/", 1)[-1], parts, first))
            total += before
        if self.want is not None and total != self.want:
            raise ValueError(f"{total} rows, not {self.want}")
        return out or [_Batches()]

    def vectors(self, batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(0)
        if column.null_count:
            raise ValueError("a vector is null")
        lengths = np.unique(column.value_lengths().to_numpy()) if not pa.types.is_fixed_size_list(column.type) else np.array([column.type.list_size])
        if len(lengths) > 1 or (self.dim is not None and len(lengths) and lengths[0] != self.dim):
            raise ValueError("the length of vectors differs")
        values = column.flatten()
        if values.null_count:
            raise ValueError("a component is null")
        flat = values.to_numpy(zero_copy_only=False).astype(np.float32)
        if not np.isfinite(flat).all():
            raise ValueError("a component isn't finite")
        return flat

    def read(self, partition):
        if not partition.parts:
            return
        system, _ = _open(self.path)
        row = partition.before
        with system.open_input_file(partition.file) as file:
            schema = _schema(file)
            names = [self.column, *([self.key] if self.key else [])]
            for name in names:
                if name not in schema.names:
                    raise ValueError(f"no column {name}")
            for offset, n_bytes in partition.parts:
                message = pa.ipc.read_message(pa.BufferReader(file.read_at(n_bytes, offset)))
                batch = pa.ipc.read_record_batch(message, schema).select(names)
                n = batch.num_rows
                flat = self.vectors(batch)
                ends = np.arange(n + 1, dtype=np.int32) * (len(flat) // max(1, n))
                key = batch.column(1).cast(pa.int64()) if self.key else pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.shard] * n, pa.string()), pa.array(np.arange(row, row + n)), key, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["shard", "row", "key", "embedding"]
                )
                row += n


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowipc"

    def schema(self) -> str:
        return "shard string, row long, key long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_arrow(spark: SparkSession, path: str, column: str, **options) -> DataFrame:
    """``shard, row, key, embedding`` of every vector; ``options`` as above."""
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format("arrowipc").option("column", column)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def write_arrow(df: DataFrame, folder: str, batch_rows: int = 4096) -> int:
    """Columns of ``df`` as one IPC stream a task, in ``folder``; the number of rows. Streams get their names when they are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        name, out, n = uuid.uuid4().hex, None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                if out is None:
                    sink = system.open_output_stream(f"{at}-parts/{name}")
                    out = pa.ipc.new_stream(sink, batch.schema)
                out.write_batch(batch.slice(a, batch_rows))
            n += batch.num_rows
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    system, at = _open(folder)
    system.create_dir(f"{at}-parts", recursive=True)
    system.create_dir(at, recursive=True)
    made = df.mapInArrow(run, "name string, n long").collect()  # a row a task
    for r in made:
        system.move(f"{at}-parts/{r['name']}", f"{at}/{r['name']}.arrows")
    system.delete_dir(f"{at}-parts")
    return sum(r["n"] for r in made)
