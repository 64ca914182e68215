"""Shared scratch storage: intermediate tables are written as Parquet and reread.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset and all tasks run in the
driver's process (tests, a laptop) a local one is chosen; on a cluster that is an error.  Tables written here cut lineage and
survive the loss of an executor.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder.
LOCAL_DEFAULT = "file:///tmp/checkpoints"
#: Whether Spark removes the shuffle files of a query once it is done; what is stored needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The URI of the shared folder for intermediate data."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_DEFAULT
    if "://" not in root and not root.startswith("file:"):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        path = hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver exits."""
    path = f"{scratch_root(spark)}/keelvault/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with as many underscores after it as it takes until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written() -> int:
    """How many intermediate tables there are."""
    return len(_WRITTEN)


def release(since: int = 0, keep: int = 0) -> None:
    """Deletes the intermediate tables written since there were ``since``, but the last ``keep``; results that still read them
    must be done."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for spark, path in reversed(gone):
        with contextlib.suppress(Exception):  # the session may have ended before
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
