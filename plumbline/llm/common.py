"""Shared pieces of the training-data operators.

Lineage is cut by ``materialize``, which writes a Parquet table below the folder
named in ``spark.checkpoint.dir`` and reads it back: the rows survive a lost
executor and later jobs read them without the work above.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import bound_batches, broadcast_if_small, materialize, shared_dir, shuffle_partitions

__all__ = ["WORD", "bound_batches", "broadcast_if_small", "held", "materialize", "read_table", "release", "shared_dir", "shuffle_partitions"]

#: A word in the sense of the operators: a run of anything but space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Drops what :func:`held` keeps, for stages that need none of it."""
    sys.__dict__.setdefault("_plumbline_held", {}).clear()


def held(key: tuple, build: Callable):
    """What a worker process keeps between tasks: one thing at a time.

    Functions travel by value, so a module's own variables are new in each task;
    the interpreter's dictionary isn't. Workers serve all stages of a job, so the
    tables of one stage make room for those of the next.
    """
    kept = sys.__dict__.setdefault("_plumbline_held", {})
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]
