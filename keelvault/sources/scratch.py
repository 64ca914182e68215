"""The shared folder for what must outlive an executor, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Used only where the session names no folder and all tasks run in the driver's process.
LOCAL_DEFAULT = "/tmp/checkpoints"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; without it, a local folder on a local master and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver exits."""
    path = f"{shared_folder(spark)}/keelvault-core/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and rereads it: lineage ends there, and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes all that was written here; results that still read it must be done."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            files.delete(spark, path)
