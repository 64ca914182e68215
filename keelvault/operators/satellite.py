"""Satellites: the history of a parent's attributes, and its end-dated view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.names import free, quoted
from ..functions.types import sortable
from ..sources.tables import read_table
from ..specs import Binding, Kept
from .hwm import TargetFacts, rows_of, sentinel
from .seams import with_neighbour


def renamed(column: str | Mapping[str, str]) -> tuple[str, str]:
    """(name in the source, name in the vault) of a column given by name or as {source_column, alias}."""
    if isinstance(column, str):
        return column, column
    return column["source_column"], column.get("alias") or column["source_column"]


def satellite(source: Binding, parent_hash_key: str, hash_diff: str | Mapping[str, str], *, payload: Sequence[str] = (), target: DataFrame | Kept | None = None, incremental: bool = False, disable_hwm: bool = False, source_is_single_batch: bool = False, hot_rows: int | None = None, cfg: VaultConfig | None = None) -> DataFrame:
    """parent_hash_key, hash diff, payload, load date, record source of the rows to insert.

    Several batches: a row equal to its predecessor (by load date) goes, so a value may come back after a change; a NULL
    hash diff equals nothing.  Incremental: the first row of a parent also goes if it equals the target's latest.  Single
    batch: each row is compared with the target's latest alone.  Where the target keeps its states, its history isn't read.

    hot_rows: parents with more rows than this are compared in slices, so that none must be sorted by one task (some steps then
    run at once); None if there are no such parents.
    """
    cfg = cfg or VaultConfig()
    if incremental and target is None:
        raise ValueError("an incremental load needs a target")
    ldts, rsrc = cfg.ldts_alias, cfg.rsrc_alias
    diff_source, diff = renamed(hash_diff)
    df = read_table(source.source, cfg.quote_identifiers)
    load = F.col(source.load_date_col or ldts)
    if incremental and not disable_hwm:
        df = df.filter(TargetFacts(target, cfg, whole=True).above(load))
    columns = [F.col(source.hash_key_col or parent_hash_key).alias(parent_hash_key), F.col(diff_source).alias(diff), *payload, load.alias(ldts), F.col(source.record_source_col or rsrc).alias(rsrc)]
    rows = df.select(*columns)
    names = rows.columns
    previous, there, first, parent, last = free(names, "_previous", "_there", "_first", "_parent", "_latest")
    if not source_is_single_batch:
        if hot_rows:
            rows = with_neighbour(rows, parent_hash_key, [ldts, diff], diff, previous, there, hot_rows=hot_rows).withColumn(first, ~F.col(there))
        else:
            order = Window.partitionBy(parent_hash_key).orderBy(F.col(ldts).asc_nulls_last(), F.col(diff).asc_nulls_last())
            rows = rows.withColumn(previous, F.lag(diff).over(order))
            rows = rows.withColumn(first, F.row_number().over(order) == 1) if incremental else rows
        rows = rows.filter(~F.coalesce(F.col(diff) == F.col(previous), F.lit(False)))
    if incremental:
        kept = target.states if isinstance(target, Kept) else None
        latest = latest_state(rows_of(target), parent_hash_key, diff, cfg) if kept is None else kept
        latest = latest.select(F.col(quoted(parent_hash_key)).alias(parent), F.col(quoted(diff)).alias(last))
        # one shuffle by parent serves the window and the join: the hash diff is compared as a condition, not as a key
        same = (F.col(parent_hash_key) == F.col(parent)) & F.col(last).between(F.col(diff), F.col(diff))
        same = same if source_is_single_batch else same & F.col(first)
        rows = rows.join(latest, same, "left_anti")
    return rows.select(*[quoted(c) for c in names])


def latest_state(target: DataFrame, parent_hash_key: str, diff: str, cfg: VaultConfig) -> DataFrame:
    """The parent and hash diff of the latest row of each parent."""
    (rank,) = free([parent_hash_key, diff, cfg.ldts_alias], "_rank")
    order = Window.partitionBy(parent_hash_key).orderBy(F.col(cfg.ldts_alias).desc_nulls_last(), F.col(diff).desc_nulls_last())
    ranked = target.select(parent_hash_key, diff, cfg.ldts_alias).withColumn(rank, F.row_number().over(order))
    return ranked.filter(F.col(rank) == 1).select(parent_hash_key, diff)


def satellite_end_dated(sat_v0: DataFrame, parent_hash_key: str, *, add_is_current: bool = True, ledts_alias: str | None = None, is_current_col: str = "is_current", hot_rows: int | None = None, cfg: VaultConfig | None = None) -> DataFrame:
    """All columns of the history, the load end date (the next load date of the parent, or the end of all times), and whether that is open.

    Rows of one parent and load date are ordered by their other columns, so that reruns give each the same end.  hot_rows: as
    for satellite().
    """
    cfg = cfg or VaultConfig()
    ledts, ldts, end = ledts_alias or cfg.ledts_alias, cfg.ldts_alias, sentinel(cfg.end_of_all_times, sat_v0, cfg.ldts_alias)
    others = [c for c in sat_v0.columns if c not in (parent_hash_key, ldts)]
    if hot_rows:
        following, there = free([*sat_v0.columns, ledts, is_current_col], "_next", "_there")
        dated = with_neighbour(sat_v0, parent_hash_key, [ldts, *others], ldts, following, there, ahead=True, hot_rows=hot_rows)
        dated = dated.select(*map(quoted, sat_v0.columns), F.coalesce(F.col(following), end).alias(ledts))
    else:
        ties = [sortable(sat_v0.schema[c]).asc_nulls_last() for c in others]
        order = Window.partitionBy(parent_hash_key).orderBy(F.col(ldts).asc_nulls_last(), *ties)
        dated = sat_v0.select("*", F.coalesce(F.lead(ldts).over(order), end).alias(ledts))
    return dated.select("*", F.coalesce(F.col(ledts) == end, F.lit(False)).alias(is_current_col)) if add_is_current else dated


def end_dated_delta(delta: DataFrame, open_rows: DataFrame, parent_hash_key: str, *, ledts_alias: str | None = None, is_current_col: str = "is_current", hot_rows: int | None = None, cfg: VaultConfig | None = None) -> DataFrame:
    """The end-dated rows that a delta makes: its own, and the rows that its parents had open, with the ends they have now.

    open_rows: the rows without an end so far, with the columns of the delta.  Every row of the delta must be later than its
    parent's open one, as high-water marks ensure; ``late_rows`` finds those that aren't.  Load dates must not be NULL.
    """
    (parent,) = free([parent_hash_key, *open_rows.columns], "_parent")
    touched = delta.select(F.col(quoted(parent_hash_key)).alias(parent)).distinct()
    before = open_rows.join(touched, F.col(quoted(parent_hash_key)) == F.col(parent), "left_semi")
    rows = before.select(*map(quoted, delta.columns)).unionAll(delta)
    return satellite_end_dated(rows, parent_hash_key, ledts_alias=ledts_alias, is_current_col=is_current_col, hot_rows=hot_rows, cfg=cfg)


def late_rows(delta: DataFrame, open_rows: DataFrame, parent_hash_key: str, cfg: VaultConfig | None = None) -> DataFrame:
    """The rows of a delta that aren't later than what their parent has open: their parents must be dated from their history."""
    ldts = (cfg or VaultConfig()).ldts_alias
    parent, since = free([*delta.columns, *open_rows.columns], "_parent", "_since")
    now = open_rows.select(F.col(quoted(parent_hash_key)).alias(parent), F.col(quoted(ldts)).alias(since))
    return delta.join(now, (F.col(quoted(parent_hash_key)) == F.col(parent)) & (F.col(quoted(ldts)) <= F.col(since)), "left_semi")
