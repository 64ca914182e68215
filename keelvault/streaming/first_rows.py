"""A hub or link from a stream without reading its target: the earliest row of each key is the stream's own state.

Late rows are kept right: a row that is earlier than the one its key has so far is a correction, and goes out again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import VaultConfig
from ..functions.names import free, quoted
from ..functions.types import sortable
from ..sources.committed import CommittedTable


def earliest(rows: DataFrame, key: str, columns: Sequence[str], cfg: VaultConfig) -> DataFrame:
    """Key, columns, load date, record source of the earliest row of each key; of ties the lowest values."""
    (rank,) = free(rows.columns, "_rank")
    ties = [sortable(rows.schema[c]).asc_nulls_last() for c in (*columns, cfg.rsrc_alias)]
    order = Window.partitionBy(quoted(key)).orderBy(F.col(quoted(cfg.ldts_alias)).asc_nulls_last(), *ties)
    ranked = rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return ranked.select(*map(quoted, (key, *columns, cfg.ldts_alias, cfg.rsrc_alias)))


def load_first_rows(rows: DataFrame, table: CommittedTable, key: str, columns: Sequence[str], checkpoint: str, *, cfg: VaultConfig | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts a query that commits, for each micro-batch, the keys that are new and those whose earliest row has changed.

    The state, one row a key, is kept by a streaming aggregate; the time of the micro-batch is part of it, which tells what has
    just come.  Nothing is read of the table.  ``first_rows`` reads it.
    """
    cfg = cfg or VaultConfig()
    names = [cfg.ldts_alias, *columns, cfg.rsrc_alias]
    # NULL last, as in a batch load
    fields = [f for i, c in enumerate(names) for f in (F.col(quoted(c)).isNull().alias(f"n{i}"), F.col(quoted(c)).alias(f"v{i}"))]
    now = F.current_timestamp()  # of the micro-batch
    timed = rows.select(F.col(quoted(key)), F.struct(*fields).alias("own"), now.alias("seen"))
    first = timed.groupBy(quoted(key)).agg(F.min(F.struct("own.*", "seen")).alias("first")).filter(F.col("first.seen") == now)
    places = {c: f"first.v{i}" for i, c in enumerate(names)}
    fresh = first.select(quoted(key), *[F.col(places[c]).alias(c) for c in (*columns, cfg.ldts_alias, cfg.rsrc_alias)])

    def load(batch: DataFrame, number: int) -> None:
        table.commit(batch, number)

    writer = fresh.writeStream.outputMode("update").foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_rows(table: CommittedTable, spark: SparkSession, columns: Sequence[str]) -> DataFrame | None:
    """What the stream has loaded: of a key that was corrected, the earliest row."""
    rows = table.rows(spark)
    return None if rows is None else earliest(rows, table.key, columns, table.cfg)
