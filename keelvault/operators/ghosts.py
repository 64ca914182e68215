"""The two ghost rows of a stage: unknown and error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.hashing import error_key, zero_key
from ..functions.types import family, spark_type
from ..specs import StageSpec


def ghost_value(column: str, type_name: str, unknown: bool, ldts: str, rsrc: str, cfg: VaultConfig) -> object:
    """Load date and record source go by their names, the rest by the family of the type."""
    kind = family(type_name)
    if column == ldts or (column != rsrc and kind in ("time", "date")):
        return cfg.beginning_of_all_times if unknown else cfg.end_of_all_times
    if column == rsrc:
        return cfg.ghost_record_rsrc if unknown else cfg.ghost_record_error_rsrc
    return {"string": "(unknown)" if unknown else "(error)", "number": -1 if unknown else -2, "boolean": False}.get(kind)


def ghost_records(spark: SparkSession, spec: StageSpec, cfg: VaultConfig | None = None) -> DataFrame:
    """Columns in the order of a staged row: source and derived, hashes, missing, sequence."""
    cfg = cfg or VaultConfig()
    ldts, rsrc = spec.load_date_col or cfg.ldts_alias, spec.record_source_col or cfg.rsrc_alias

    def row(unknown: bool) -> DataFrame:
        values: list[Column] = []
        if spec.include_source_columns:
            values += [F.lit(ghost_value(c, t, unknown, ldts, rsrc, cfg)).cast(spark_type(t)).alias(c) for c, t in spec.ghost_record_types.items()]
        values += [F.lit(zero_key(cfg.hash) if unknown else error_key(cfg.hash)).alias(c) for c in spec.hashed_columns]
        values += [F.lit(None).cast(spark_type(t)).alias(c) for c, t in spec.missing_columns.items()]
        values += [F.lit(None).cast("bigint").alias(spec.sequence)] if spec.sequence else []
        return spark.range(0, 1, 1, 1).select(*values)

    return row(True).unionAll(row(False))
