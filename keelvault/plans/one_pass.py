"""A whole load in one pass: hub, link and satellite rows leave one scan of the raw table together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import VaultConfig
from ..functions.names import quoted
from ..operators.satellite import satellite_end_dated
from ..operators.stage import stage
from ..specs import StageSpec
from .pipeline import VaultLoad

HUB, LINK, SATELLITE = "hub", "link", "satellite"


@dataclass(frozen=True)
class _Entity:
    """Columns of an entity, its key first."""

    name: str
    key: str
    columns: tuple[str, ...]


def tagged_rows(staged: DataFrame, entities: list[_Entity], diff: str, cfg: VaultConfig) -> DataFrame:
    """entity, key and a struct for each entity, of the rows to insert in an initial load.

    Each staged row becomes one tagged row an entity, and all of them are shuffled once, by entity and key.  One window serves
    all: hubs and links keep the first row of a key, satellites the rows whose hash diff isn't the one before.  Where one key
    holds much of a table, ``load_vault`` is the way: its hubs and links send one row of a key from each task.
    """
    kinds = {e.name: StructType([staged.schema[c] for c in e.columns]) for e in entities}

    def tagged(entity: _Entity) -> Column:
        own = F.struct(*[F.col(quoted(c)) for c in entity.columns])
        bodies = [(own if e is entity else F.lit(None)).cast(kinds[e.name]).alias(e.name) for e in entities]
        change = F.col(quoted(diff)) if entity.name == SATELLITE else F.lit(None).cast("string")
        return F.struct(F.lit(entity.name).alias("entity"), F.col(quoted(entity.key)).alias("key"), F.col(quoted(cfg.ldts_alias)).alias("at"), change.alias("diff"), *bodies)

    rows = staged.select(F.inline(F.array(*map(tagged, entities))))
    order = Window.partitionBy("entity", "key").orderBy(F.col("at").asc_nulls_last(), F.col("diff").asc_nulls_last(), HUB, LINK)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("diff").over(order))
    keep = F.when(F.col("entity") == SATELLITE, ~F.coalesce(F.col("diff") == F.col("before"), F.lit(False))).otherwise(F.col("place") == 1)
    return rows.filter(keep).select("entity", "key", *[e.name for e in entities])


def load_vault_once(spec: StageSpec, into: str, *, hash_key: str, business_keys: list[str], link_key: str, foreign_keys: list[str], hash_diff: str, payload: list[str], cfg: VaultConfig | None = None) -> VaultLoad:
    """Initial load of a hub, a link and a satellite, written at once under ``into`` in a folder each, from one scan of the raw
    table and one shuffle; no stage is written.  The relations read what was written.
    """
    cfg = cfg or VaultConfig()
    staged, ends = stage(spec, cfg=cfg), (cfg.ldts_alias, cfg.rsrc_alias)
    entities = [_Entity(HUB, hash_key, (hash_key, *business_keys, *ends)), _Entity(LINK, link_key, (link_key, *foreign_keys, *ends)), _Entity(SATELLITE, hash_key, (hash_key, hash_diff, *payload, *ends))]
    rows = tagged_rows(staged, entities, hash_diff, cfg)
    rows.drop("key").write.partitionBy("entity").parquet(into)
    spark = staged.sparkSession
    written = spark.read.schema(rows.drop("key").schema).parquet(into)
    hub, link, history = (written.filter(F.col("entity") == e.name).select(*[F.col(f"{e.name}.{quoted(c)}") for c in e.columns]) for e in entities)
    return VaultLoad(staged, hub, link, history, satellite_end_dated(history, hash_key, cfg=cfg))
