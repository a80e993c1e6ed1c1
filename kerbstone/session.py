"""Session settings and the shared folders long jobs write to."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without the setting: there a temporary folder
    is as good, because driver and executors share one machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="kerbstone-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


# What this process has written there.
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table or a model."""
    path = posixpath.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def remove_scratch() -> None:
    """Remove what this process has written under the shared folder: for the end of a whole
    run, when its results are stored elsewhere. What can't be reached is left."""
    while _written:
        path = _written.pop()
        try:
            files, inside = FileSystem.from_uri(path if "://" in path else f"file://{path}")
            files.delete_dir(inside)
        except (OSError, pa.ArrowException):
            continue


def settle(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards.

    For tables that several passes need (model rounds, folds): the work above
    is not redone, each pass reads only its columns, and a lost executor costs a
    file read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
