"""Staging: hashes, derived and placeholder columns, a sequence and ghost rows over a raw table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.hashing import hash_expr
from ..functions.types import spark_type
from ..sources.scratch import stored
from ..sources.tables import read_table
from ..specs import HashRule, Kept, StageSpec
from .ghosts import ghost_records
from .hwm import TargetFacts

#: Inner names, which no table should have.
PLACE, SEQUENCE = "__place__", "__sequence__"


def stage(spec: StageSpec, *, target: DataFrame | Kept | None = None, incremental: bool = False, pass_empty_target: bool = False, cfg: VaultConfig | None = None) -> DataFrame:
    """The staged rows.

    Incremental: rows above the target's latest load date, by the settings' load-date name, before anything is derived; with
    an empty target none pass unless pass_empty_target.  Without source columns, derived ones are dropped with them.  Derived
    columns see raw columns only.  Ghost rows must name the source and derived columns in their order.
    """
    cfg = cfg or VaultConfig()
    df = read_table(spec.source, cfg.quote_identifiers)
    if incremental:
        if target is None:
            raise ValueError("an incremental stage needs a target")
        df = df.filter(TargetFacts(target, cfg, whole=True).above(F.col(cfg.ldts_alias), pass_empty_target))
    if spec.derived_columns:
        clash = {c.lower() for c in df.columns} & {c.lower() for c in spec.derived_columns}
        if clash:
            raise ValueError(f"derived columns {sorted(clash)} are columns of the source as well")
        df = df.select("*", *[F.expr(e).alias(a) for a, e in spec.derived_columns.items()])
    columns: list[Column | str] = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns] if spec.include_source_columns else []
    if spec.sequence:
        df = numbered(df, spec)
    for alias, given in spec.hashed_columns.items():
        rule = HashRule.of(given)
        columns.append(hash_expr(rule.columns, cfg, is_hashdiff=rule.is_hashdiff, case_sensitive=rule.choice("case_sensitivity", spec.case_sensitivity), trim=rule.choice("use_rtrim", spec.use_rtrim)).alias(alias))
    columns += [F.lit(None).cast(spark_type(t)).alias(c) for c, t in spec.missing_columns.items()]
    if spec.sequence:
        columns.append(F.col(SEQUENCE).alias(spec.sequence))
    if not columns:
        raise ValueError("a stage needs at least one column")
    staged = df.select(*columns)
    if not spec.ghost_record_types:
        return staged
    ghosts = ghost_records(df.sparkSession, spec, cfg)
    if [c.lower() for c in ghosts.columns] != [c.lower() for c in staged.columns]:
        raise ValueError(f"ghost rows have the columns {ghosts.columns}, staged rows {staged.columns}")
    return staged.unionAll(ghosts)


def numbered(df: DataFrame, spec: StageSpec) -> DataFrame:
    """The rows with SEQUENCE, 1 to n without gaps, in the order that the spec names or of the rows' JSON.

    Rows are cut into ranges and sorted and numbered in each; the ranges' counts (a row each) give where each begins.  The
    numbered ranges are written to the shared folder, as a second evaluation might cut them elsewhere; so this runs at once.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]))
    order = [F.col(c).asc_nulls_last() for c in spec.sequence_order] + [F.xxhash64(whole) if spec.sequence_order else whole]
    ranges = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id()), "sequence")
    part, place = F.shiftright(PLACE, 33), F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    before, begins = 0, []
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():  # as many rows as ranges
        begins.append((r["part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(begins, "_part long, _begin long")
    return ranges.join(F.broadcast(offsets), part == F.col("_part")).withColumn(SEQUENCE, F.col("_begin") + place + 1).drop(PLACE, "_part", "_begin")
