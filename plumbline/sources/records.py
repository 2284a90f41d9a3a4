"""Candidate records, CSR arrays, line-wise JSON, tables and configurations."""

from __future__ import annotations

import contextlib
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .xvecs import _open

#: Packed candidate records, 12 bytes each.
RECORD = np.dtype([("id", "<i4"), ("exact", "<f4"), ("pq", "<f4")])
#: Endings of a task's files, and the list of those that a finished job has written.
RECORDS, INDEX, LIST = ".records", ".index.parquet", "_list.json"


def unpack_candidates(files: DataFrame) -> DataFrame:
    """``query_id, pos, base_id, exact, score`` from rows ``(query_id, content)`` of packed records."""

    def run(batches):
        for rows in batches:
            for q, raw in zip(rows["query_id"], rows["content"], strict=True):
                if len(raw) % RECORD.itemsize:
                    raise ValueError(f"records of query {q} end within a record")
                r = np.frombuffer(raw, RECORD)
                yield pd.DataFrame({"query_id": q, "pos": np.arange(len(r), dtype=np.int64), "base_id": r["id"].astype(np.int64), "exact": r["exact"].astype(float), "score": r["pq"].astype(float)})

    return files.mapInPandas(run, "query_id long, pos long, base_id long, exact double, score double")


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _PackedWriter(DataSourceArrowWriter):
    """A file of records and one of their index a task; a list of the files makes them visible."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        name, at_byte, out, left = uuid.uuid4().hex, 0, [], None
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        try:
            with system.open_output_stream(f"{at}/{name}{RECORDS}") as file:
                for batch in iterator:
                    rows = batch.to_pandas()
                    if rows[["query_id", "base_id", "exact", "score"]].isna().to_numpy().any():
                        raise ValueError("a record's value is null or NaN")
                    rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
                    last = rows["query_id"].iloc[-1] if len(rows) else None
                    left = rows[rows["query_id"] == last]  # it may go on in the next batch
                    for q, part in rows[rows["query_id"] != last].groupby("query_id", sort=True):
                        out.append((q, name, at_byte, len(part)))
                        at_byte += file.write(_records(part))
                if left is not None and len(left):
                    out.append((left["query_id"].iloc[0], name, at_byte, len(left)))
                    file.write(_records(left))
            index = pd.DataFrame(out, columns=["query_id", "file", "byte_offset", "candidate_count"]).astype({"query_id": "int64", "byte_offset": "int64", "candidate_count": "int64"})
            with system.open_output_stream(f"{at}/{name}{INDEX}") as file:
                pq.write_table(pa.Table.from_pandas(index, preserve_index=False), file)
        except BaseException:
            _remove(system, at, name)
            raise
        return _Written(name)

    def commit(self, messages):
        system, at = _open(self.path)
        with system.open_output_stream(f"{at}/{LIST}.part") as file:
            file.write(json.dumps(sorted(m.name for m in messages if m)).encode())
        system.move(f"{at}/{LIST}.part", f"{at}/{LIST}")

    def abort(self, messages):
        system, at = _open(self.path)
        for m in messages:
            if m:
                _remove(system, at, m.name)


def _remove(system, at: str, name: str) -> None:
    for ending in (RECORDS, INDEX):
        with contextlib.suppress(OSError):
            system.delete_file(f"{at}/{name}{ending}")


class PackedSource(DataSource):
    """``df.write.format("packedrecords").mode("append").save(folder)`` of ``query_id, pos, base_id, exact, score``."""

    @classmethod
    def name(cls) -> str:
        return "packedrecords"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("packed records aren't overwritten")
        return _PackedWriter(self.options["path"])


def pack_candidates(pool: DataFrame, folder: str) -> DataFrame:
    """Writes ``pool(query_id, pos, base_id, exact, score)``; its index ``query_id, file, byte_offset, candidate_count``.

    A task writes the queries of its range one after the other into a file of its own,
    and their index beside it. The job's last act is a list of the files: without it,
    after a failure, nothing can be read, and what was written is deleted. Records and
    index stay where they are, and any process reads them by :func:`packed_index`.
    """
    spark = pool.sparkSession
    system, at = _open(folder)
    if system.get_file_info(f"{at}/{LIST}").type.name != "NotFound":
        raise ValueError(f"{folder} has records")
    spark.dataSource.register(PackedSource)
    laid = pool.select(*[F.col(c).cast(t) for c, t in (("query_id", "long"), ("pos", "long"), ("base_id", "long"), ("exact", "double"), ("score", "double"))]).repartition("query_id").sortWithinPartitions("query_id", "pos")
    laid.write.format("packedrecords").mode("append").save(folder)
    return packed_index(spark, folder)


def packed_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder of packed records; an error where no job has ended."""
    system, at = _open(folder)
    with system.open_input_file(f"{at}/{LIST}") as file:
        names = json.loads(file.read())
    schema = "query_id long, file string, byte_offset long, candidate_count long"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/{n}{INDEX}" for n in names])


def _records(rows: pd.DataFrame) -> bytes:
    out = np.zeros(len(rows), RECORD)
    out["id"], out["exact"], out["pq"] = rows["base_id"], rows["exact"], rows["score"]
    return out.tobytes()


def scan_candidates(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, by their offsets."""

    def run(batches):
        system, at = _open(folder)
        for rows in batches:
            for name, part in rows.groupby("file"):
                with system.open_input_file(f"{at}/{name}{RECORDS}") as file:
                    yield pd.DataFrame({"query_id": part["query_id"], "content": [file.read_at(int(n) * RECORD.itemsize, int(a)) for a, n in zip(part["byte_offset"], part["candidate_count"], strict=True)]})

    return unpack_candidates(index.mapInPandas(run, "query_id long, content binary"))


def from_csr(rows: DataFrame) -> DataFrame:
    """``query_id, pos, base_id, score`` from ``query_id, ids, scores``."""
    return rows.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "x")).select("query_id", F.col("pos").cast("long").alias("pos"), F.col("x.ids").alias("base_id"), F.col("x.scores").alias("score"))


def to_csr(pool: DataFrame) -> DataFrame:
    """One row a query: ids and scores in pool order, and the offset of its first candidate."""
    rows = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "base_id", "score"))).alias("x")).withColumn("bucket", F.floor(F.col("query_id") / 65536))
    # offsets in two steps: a window over the buckets, and one over each bucket's queries
    sizes = rows.groupBy("bucket").agg(F.sum(F.size("x")).alias("n"))
    before = sizes.select(F.col("bucket").alias("b"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.sum(F.size("x")).over(Window.partitionBy("bucket").orderBy("query_id")) - F.size("x")
    placed = rows.withColumn("within", within).join(before, F.col("bucket") == F.col("b"))
    return placed.select("query_id", (F.col("before") + F.col("within")).alias("offset"), F.transform("x", lambda e: e["base_id"]).alias("ids"), F.transform("x", lambda e: e["score"]).alias("scores"))


def write_json_lines(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("errorifexists").option("compression", "gzip" if compress else "none").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_tables(tables: list[DataFrame], path: str) -> None:
    """CSV over the union of all columns, in the order in which they first occur."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("errorifexists").option("header", True).csv(path)


def read_config(spark: SparkSession, path: str, known: set[str] | None = None) -> dict[str, str]:
    """``key=value`` lines; ``#`` starts a comment. A repeated or unknown key is an error."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    lines = [r[0] for r in spark.read.text(path).select(text.alias("v")).filter("v <> ''").collect()]
    out: dict[str, str] = {}
    for line in lines:
        key, sep, value = line.partition("=")
        key = key.strip()
        if not sep or key in out or (known is not None and key not in known):
            raise ValueError(f"bad configuration line: {line}")
        out[key] = value.strip()
    return out


def list_value(value: str) -> list[tuple[str, ...]]:
    """``a:b,c:d`` -> tuples."""
    return [tuple(part.split(":")) for part in value.split(",")]
