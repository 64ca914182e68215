"""Targets bucketed by hash key, so that a load's exclusion of known keys moves the source alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import free, quoted


def create_bucketed(spark: SparkSession, name: str, schema: StructType, key: str, buckets: int, path: str | None = None) -> None:
    """An empty catalog table in buckets by the key, each sorted by it."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    place = "" if path is None else " LOCATION '{}'".format(path.replace("'", "\\'"))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(key)}) SORTED BY ({quoted(key)}) INTO {buckets} BUCKETS{place}")


def append_bucketed(delta: DataFrame, name: str, key: str, buckets: int) -> None:
    """Appends by name; dealt out as the buckets are, so that each load adds one file to a bucket."""
    columns = delta.sparkSession.table(name).columns
    delta.select(*map(quoted, columns)).repartition(buckets, quoted(key)).write.insertInto(name)


#: Bits of the map of a delta's keys: 2 MB, whatever the number of keys.
KEY_BITS = 24


def near_keys(target: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The target's rows whose key may be among the delta's: for a delta that is small beside its target.

    A bit map of the delta's keys is broadcast and looked up while the target is scanned, so the join that follows sorts little.
    No key of the delta is lost; where the map fills up, more rows stay.  NULL keys stay.
    """
    at, bits, word, bit = free([*target.columns, *delta.columns], "_at", "_bits", "_word", "_bit")
    place = F.shiftrightunsigned(F.xxhash64(quoted(key)), 64 - KEY_BITS)
    parts = [F.shiftright(place, 6).cast("int"), place.bitwiseAND(63).cast("int")]
    known = delta.select(parts[0].alias(word), parts[1].alias(bit)).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits))
    rows = target.select("*", parts[0].alias(at), parts[1].alias(bit)).join(F.broadcast(known), F.col(at) == F.col(word), "left")
    there = F.coalesce(F.expr(f"shiftright({bits}, {bit}) & 1L"), F.lit(0)) == 1
    return rows.filter(there | F.col(quoted(key)).isNull()).select(*map(quoted, target.columns))
