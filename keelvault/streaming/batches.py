"""A stream loads a vault batch by batch: each micro-batch is an incremental load against the table as it is then."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.committed import CommittedTable
from ..sources.tables import append, read_table
from ..specs import Kept


def load_stream(rows: DataFrame, target: str | CommittedTable, delta: Callable[[DataFrame, DataFrame | Kept | None], DataFrame], checkpoint: str, partition_by: tuple[str, ...] = (), available_now: bool = False) -> StreamingQuery:
    """Starts a query that loads delta(batch, current target or None) into ``target``.

    A committed table, or a path, which becomes one: a batch is published whole and once, under the stream's name (from its
    checkpoint) and number; one that died before leaves nothing that ``CommittedTable.rows`` sees.  A committed table gives its
    target with marks and states, a path its rows.

    A catalog table's name: batches are appended, and marked beside the checkpoint after that; between append and mark a failure
    may repeat one, which only marks or keys of the target then keep from being inserted twice.
    """
    place = checkpoint.rstrip("/")
    stream = hashlib.md5(place.encode()).hexdigest()[:12]
    table = target if isinstance(target, CommittedTable) else CommittedTable(target, partition_by=partition_by) if "/" in target else None

    def commit(batch: DataFrame, number: int) -> None:
        make = lambda kept: delta(batch, kept if kept is None or target is table else kept.rows)
        table.load(batch.sparkSession, f"{stream}-{number:09}", make)

    def insert(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{place}-batches/{number}"
        if files.exists(spark, mark):
            return
        append(delta(batch, read_table(target, spark=spark) if spark.catalog.tableExists(target) else None), target, partition_by)
        files.publish(spark, mark, "")

    writer = rows.writeStream.foreachBatch(insert if table is None else commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
