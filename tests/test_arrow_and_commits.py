"""Arrow files and streams by ranges; sinks that show nothing until a job has ended."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from plumbline.sources import arrow_ipc, records

VECTORS = np.arange(2500 * 4, dtype=np.float32).reshape(2500, 4)


def table(vectors=VECTORS, kind=None):
    flat = pa.array(vectors.ravel())
    lists = pa.FixedSizeListArray.from_arrays(flat, 4) if kind == "fixed" else pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * 4), flat)
    n = len(vectors)
    return pa.table({"title": [f"t{k}" * 50 for k in range(n)], "id": pa.array(np.arange(n) * 2), "v": lists})


def write(path, data, stream, rows=300):
    with pa.OSFile(str(path), "wb") as sink:
        with (pa.ipc.new_stream if stream else pa.ipc.new_file)(sink, data.schema) as out:
            out.write_table(data, max_chunksize=rows)


@pytest.mark.parametrize("stream", [True, False])
@pytest.mark.parametrize("kind", [None, "fixed"])
def test_ranges_of_batches(spark, tmp_path, monkeypatch, stream, kind):
    for shard in ("a", "b"):
        write(tmp_path / f"{shard}.arrow", table(kind=kind), stream)
    with pa.OSFile(str(tmp_path / "a.arrow")) as file:
        found = arrow_ipc.batches_of(file, file.size())
    assert [r for *_, r in found] == [300] * 8 + [100]
    monkeypatch.setattr(arrow_ipc, "RANGE", 100_000)
    df = arrow_ipc.read_arrow(spark, str(tmp_path), "v", key="id", dimension=4, rows=5000)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((f"{s}.arrow", k, 2 * k, VECTORS[k].tolist()) for s in "ab" for k in range(2500))
    options = {"path": str(tmp_path), "column": "v"}
    assert len(arrow_ipc._Reader(options).partitions()) > 4


def test_only_asked_columns_are_needed(spark, tmp_path):
    write(tmp_path / "a.arrows", table(), True)
    assert arrow_ipc.read_arrow(spark, str(tmp_path), "v").filter("key IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="no column"):
        arrow_ipc.read_arrow(spark, str(tmp_path), "w").collect()


@pytest.mark.parametrize(
    "rows,options,message",
    [
        ([[1.0, 2.0], None], {}, "a vector is null"),
        ([[1.0, 2.0], [1.0, None]], {}, "a component is null"),
        ([[1.0, 2.0], [1.0]], {}, "length of vectors differs"),
        ([[1.0, 2.0], [1.0, 3.0]], {"dimension": 3}, "length of vectors differs"),
        ([[1.0, float("nan")]], {}, "isn't finite"),
        ([[1.0, 2.0]], {"rows": 2}, "1 rows, not 2"),
    ],
)
def test_what_is_rejected(spark, tmp_path, rows, options, message):
    write(tmp_path / "a.arrows", pa.table({"v": pa.array(rows, pa.list_(pa.float32()))}), True)
    with pytest.raises(Exception, match=message):
        arrow_ipc.read_arrow(spark, str(tmp_path), "v", **options).collect()


def test_cut_files_are_errors(spark, tmp_path):
    write(tmp_path / "a.arrows", table(), True)
    whole = (tmp_path / "a.arrows").read_bytes()
    (tmp_path / "a.arrows").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends within a message"):
        arrow_ipc.read_arrow(spark, str(tmp_path), "v").collect()
    (tmp_path / "a.arrows").write_bytes(b"no arrow file at all")
    with pytest.raises(Exception, match="no message"):
        arrow_ipc.read_arrow(spark, str(tmp_path), "v").collect()


def test_written_streams(spark, tmp_path):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1000)], "id long, v array<float>").repartition(3)
    assert arrow_ipc.write_arrow(df, f"file://{tmp_path}/out", batch_rows=64) == 1000
    got = arrow_ipc.read_arrow(spark, f"file://{tmp_path}/out", "v", key="id", rows=1000)
    assert sorted((r["key"], r["embedding"]) for r in got.collect()) == [(k, [float(k), 1.0]) for k in range(1000)]


def pool(spark, n=50):
    return spark.createDataFrame([(q, k, 10 * q + k, 0.5 * k, 0.25 * k) for q in range(n) for k in range(7)], "query_id long, pos long, base_id long, exact double, score double")


def test_another_process_reads_packed_records(spark, tmp_path):
    folder = f"file://{tmp_path}/packed"
    code = f"""
import sys
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from plumbline.sources import records
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
rows = [(q, k, 10 * q + k, 0.5 * k, 0.25 * k) for q in range(50) for k in range(7)]
records.pack_candidates(spark.createDataFrame(rows, "query_id long, pos long, base_id long, exact double, score double"), {folder!r})
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    got = records.scan_candidates(records.packed_index(spark, folder), folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pool(spark).collect()))
    with pytest.raises(ValueError, match="has records"):
        records.pack_candidates(pool(spark), folder)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = pool(spark).selectExpr("query_id", "pos", "base_id", "exact", "IF(query_id = 33 AND pos = 3, NULL, score) AS score")
    with pytest.raises(Exception, match="null or NaN"):
        records.pack_candidates(bad, f"file://{tmp_path}/packed")
    with pytest.raises(FileNotFoundError):
        records.packed_index(spark, f"file://{tmp_path}/packed")
    assert list((tmp_path / "packed").iterdir()) == []
    index = records.pack_candidates(pool(spark), f"file://{tmp_path}/packed")  # the folder can be used again
    assert index.count() == 50
