"""Tables written once to the shared folder and read again."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


#: Folders of this process's sessions, deleted when it ends (and not when a fork of it does).
_roots: set[tuple[int, str]] = set()


def _delete(root: str) -> None:
    from pyarrow import fs

    with contextlib.suppress(OSError, ValueError):
        system, at = fs.FileSystem.from_uri(root)
        system.delete_dir(at)


@atexit.register
def _delete_all() -> None:
    for process, root in _roots:
        if process == os.getpid():
            _delete(root)


def shared_root(spark: SparkSession) -> str:
    """The folder of this application below the one that the cluster shares.

    Where none is set, a local session takes the machine's temporary folder, with
    a warning; a cluster is an error, since executors wouldn't see one another's files.
    The name has its scheme, so that Spark and Python workers find the same place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/plumbline-shared"
        warnings.warn(f"spark.checkpoint.dir isn't set: {root} is used", stacklevel=3)
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    root = f"{re.sub('^file:/+', 'file:///', root)}/plumbline-{spark.sparkContext.applicationId}"
    _roots.add((os.getpid(), root))
    return root


def shared_dir(spark: SparkSession) -> str:
    """A new folder below :func:`shared_root`."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder.

    DataFrames made before can't be read any more. The end of the process does the same.
    """
    _delete(shared_root(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read again: the lineage above is cut and not computed twice."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of long rows that go to a Python worker at a time.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on Arrow batches: whole texts and vectors are large rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` is a count of ``df``; beyond the bound Spark shuffles as it likes."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
