"""An end-dated satellite that is kept up to date: a load reads and writes what its delta touches.

The rows are a committed table in two folders: closed rows are final and only added to; of the open ones each parent's latest
counts, as a load writes a new one for each parent that it touches.  So a load reads the open rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.names import free, quoted
from ..functions.types import sortable
from ..operators.satellite import end_dated_delta, late_rows, satellite_end_dated
from .committed import CommittedTable


@dataclass(frozen=True)
class EndDatedTable:
    """The end-dated view of a satellite, as a table under a path."""

    path: str
    parent_hash_key: str
    is_current_col: str = "is_current"
    cfg: VaultConfig = VaultConfig()

    @property
    def table(self) -> CommittedTable:
        return CommittedTable(self.path, partition_by=(self.is_current_col,), cfg=self.cfg)

    def open_rows(self, spark: SparkSession) -> DataFrame | None:
        """The row without an end of each parent; None before the first load.  Closed rows aren't read."""
        rows = self.table.rows(spark)
        if rows is None:
            return None
        rows = rows.filter(F.col(quoted(self.is_current_col)))
        (rank,) = free(rows.columns, "_rank")
        ties = [sortable(f).desc_nulls_first() for f in rows.schema if f.name not in (self.parent_hash_key, self.cfg.ldts_alias, self.cfg.ledts_alias, self.is_current_col)]
        order = Window.partitionBy(quoted(self.parent_hash_key)).orderBy(F.col(quoted(self.cfg.ldts_alias)).desc(), *ties)
        return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)

    def load(self, delta: DataFrame, batch: str | int, *, check_late: bool = True) -> bool:
        """Adds a satellite's delta; False if the batch is there already.

        check_late: whether to look first for rows that aren't later than their parent's open one, which are an error here.
        """
        spark = delta.sparkSession
        if self.table.committed(spark, batch):
            return False
        before = self.open_rows(spark)
        if before is None:
            before = delta.limit(0)
        elif check_late and not late_rows(delta, before, self.parent_hash_key, self.cfg).isEmpty():
            raise ValueError("rows of the delta aren't later than what their parents have open: remake() the table")
        return self.table.commit(end_dated_delta(delta, before, self.parent_hash_key, is_current_col=self.is_current_col, cfg=self.cfg), batch)

    def view(self, spark: SparkSession) -> DataFrame | None:
        """All rows with their ends."""
        rows = self.table.rows(spark)
        if rows is None:
            return None
        return rows.filter(~F.col(quoted(self.is_current_col))).unionByName(self.open_rows(spark))

    def remake(self, history: DataFrame, batch: str | int, hot_rows: int | None = None) -> bool:
        """All rows dated anew from a satellite's whole history, which has taken in rows that came late."""
        return self.table.replace(satellite_end_dated(history, self.parent_hash_key, is_current_col=self.is_current_col, hot_rows=hot_rows, cfg=self.cfg), batch)

    def compact(self, spark: SparkSession, batch: str | int) -> bool:
        """Leaves the versions of open rows behind that later loads have closed, and gathers small files."""
        view = self.view(spark)
        return view is not None and self.table.replace(view, batch)
