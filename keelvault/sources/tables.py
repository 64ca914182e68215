"""Table references, scans and the append of a delta."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableRef:
    """A table by name, in up to three parts."""

    table_name: str
    schema: str | None = None
    database: str | None = None

    def __post_init__(self) -> None:
        if not self.table_name:
            raise ValueError("a table reference needs a table name")

    def identifier(self, quote: bool = True) -> str:
        parts = [p for p in (self.database, self.schema, self.table_name) if p]
        return ".".join(f"`{p.replace('`', '``')}`" if quote else p for p in parts)


def read_table(source: DataFrame | TableRef | str, quote: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """The DataFrame itself, a catalog table by reference or name, or a file by a path with a scheme or a slash."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    if isinstance(source, TableRef):
        return spark.table(source.identifier(quote))
    if "/" in source:
        kind = next((k for k in ("json", "csv", "orc", "avro") if source.rstrip("/").endswith("." + k)), "parquet")
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        return reader.format(kind).load(source)
    return spark.table(source)


def spread(df: DataFrame, *columns: str, piece_bytes: int | None = None) -> DataFrame:
    """A plain scan of a table that is in fewer pieces than there are cores is dealt out by the columns, so that what is computed
    of its rows runs on all of them; a table in more pieces stays as it is.

    piece_bytes: of a larger table the pieces have about so many bytes of its files, so that what its rows become can be sorted
    in a task's memory.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if piece_bytes:
        wanted = max(wanted, -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // piece_bytes))
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(wanted, *columns) if pieces < wanted else df


def append(delta: DataFrame, target: TableRef | str, partition_by: tuple[str, ...] = ()) -> None:
    """Appends a delta to a catalog table, which is made if it isn't there, or to Parquet files under a path.

    Columns go by their names, whatever their order; a table that is there must have just the delta's columns.
    """
    if isinstance(target, str) and "/" in target:
        delta.write.mode("append").partitionBy(*partition_by).parquet(target)
        return
    name = target.identifier() if isinstance(target, TableRef) else target
    if delta.sparkSession.catalog.tableExists(name):
        columns = delta.sparkSession.table(name).columns
        if sorted(map(str.lower, columns)) != sorted(map(str.lower, delta.columns)):
            raise ValueError(f"the delta has the columns {delta.columns}, {name} has {columns}")
        delta.select(*[f"`{c}`" for c in columns]).write.insertInto(name)
    else:
        delta.write.partitionBy(*partition_by).saveAsTable(name)
