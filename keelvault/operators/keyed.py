"""Hubs and links: the earliest row of each hash key over all sources that the target doesn't have yet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.hashing import packed, unpacked
from ..functions.names import free, quoted
from ..functions.types import sortable
from ..sources.tables import read_table
from ..specs import Binding, Kept, StageSpec
from .hwm import TargetFacts
from .numbered_keys import first_by_numbers
from .stage import stage


def hub(sources: Sequence[Binding], hash_key: str, business_keys: Sequence[str], *, target: DataFrame | Kept | None = None, incremental: bool = False, disable_hwm: bool = False, additional_columns: Sequence[str] = (), cfg: VaultConfig | None = None) -> DataFrame:
    """hash_key, business keys, additional columns, load date, record source of the rows to insert."""
    if not business_keys:
        raise ValueError("a hub needs at least one business key")
    for b in sources:
        if b.bk_columns is not None and len(b.bk_columns) != len(business_keys):
            raise ValueError(f"{len(b.bk_columns)} business-key columns for {len(business_keys)} business keys")
    columns = [b.bk_columns or business_keys for b in sources]
    return _keyed(sources, hash_key, business_keys, columns, target, incremental, disable_hwm, additional_columns, cfg or VaultConfig())


def link(sources: Sequence[Binding], link_hash_key: str, foreign_hash_keys: Sequence[str], *, target: DataFrame | Kept | None = None, incremental: bool = False, disable_hwm: bool = False, additional_columns: Sequence[str] = (), cfg: VaultConfig | None = None) -> DataFrame:
    """link_hash_key, foreign hash keys, additional columns, load date, record source of the rows to insert.

    A first load whose sources are all StageSpecs is ranked before it is hashed, where its keys are hashes of whole numbers.
    """
    if not foreign_hash_keys:
        raise ValueError("a link needs at least one foreign hash key")
    for b in sources:
        if b.fk_columns is not None and len(b.fk_columns) != len(foreign_hash_keys):
            raise ValueError(f"{len(b.fk_columns)} foreign-key columns for {len(foreign_hash_keys)} foreign hash keys")
    columns = [b.fk_columns or foreign_hash_keys for b in sources]
    return _keyed(sources, link_hash_key, foreign_hash_keys, columns, target, incremental, disable_hwm, additional_columns, cfg or VaultConfig(), packs=True)


def _keyed(sources: Sequence[Binding], key: str, names: Sequence[str], columns: Sequence[Sequence[str]], target: DataFrame | Kept | None, incremental: bool, disable_hwm: bool, additional: Sequence[str], cfg: VaultConfig, packs: bool = False) -> DataFrame:
    if not sources:
        raise ValueError("an entity needs at least one source")
    if incremental and target is None:
        raise ValueError("an incremental load needs a target")
    extras = [tuple(b.additional_columns or additional) for b in sources]
    if len(set(extras)) > 1:
        raise ValueError(f"the sources' additional columns differ: {extras}")
    if packs and not incremental and (unhashed := first_by_numbers(sources, key, names, columns, extras[0], cfg)) is not None:
        return unhashed
    specs = {id(b.source): b.source for b in sources if isinstance(b.source, StageSpec)}
    stages = {i: stage(spec, cfg=cfg) for i, spec in specs.items()}
    sources = [replace(b, source=stages.get(id(b.source), b.source)) for b in sources]
    ldts, rsrc = cfg.ldts_alias, cfg.rsrc_alias
    source, rank = free([key, *names, *extras[0], ldts, rsrc], "_source", "_rank")
    facts, marked = None, incremental and not disable_hwm
    patterns = [p for b in sources for p in b.rsrc_statics or ()] if marked else []
    whole = marked and len(sources) == 1 and not patterns
    if incremental:
        facts = TargetFacts(target, cfg, whole=whole, patterns=patterns, key=key)

    def shaped(place: int) -> list[Column]:
        """A binding's columns under the entity's names, and its place, which breaks ties."""
        b = sources[place]
        own = [F.col(c).alias(n) for c, n in zip(columns[place], names, strict=True)]
        load, record = F.col(b.load_date_col or ldts), F.col(b.record_source_col or rsrc)
        return [F.col(b.hash_key_col or key).alias(key), *own, *map(F.col, extras[place]), load.alias(ldts), record.alias(rsrc), F.lit(place).alias(source)]

    def above(rows: DataFrame, place: int) -> DataFrame:
        """The rows above their marks; a source without patterns isn't filtered beside others."""
        if whole:
            return rows.filter(facts.above(F.col(ldts)))
        statics = sources[place].rsrc_statics if patterns else ()
        return facts.passing(rows, rsrc, ldts, statics) if statics else rows

    def read(places: list[int]) -> DataFrame:
        df = read_table(sources[places[0]].source, cfg.quote_identifiers)
        if len(places) == 1:
            return above(df.select(*shaped(places[0])), places[0])
        return df.select(F.inline(F.array(*[F.struct(*shaped(i)) for i in places])))  # read and hashed once

    # bindings of one table without marks of their own are read together
    groups: dict[tuple, list[int]] = {}
    for i, b in enumerate(sources):
        groups.setdefault((id(b.source) if isinstance(b.source, DataFrame) else b.source, i if whole or (patterns and b.rsrc_statics) else None), []).append(i)
    rows = reduce(DataFrame.unionByName, map(read, groups.values()))
    # a first load has nothing to meet, so its keys may travel as bytes
    keys = [] if incremental or not packs else [c for c in dict.fromkeys((key, *names)) if rows.schema[c].dataType.typeName() == "string"]
    given = rows.columns
    rows = rows.withColumns({c: packed(F.col(quoted(c))) for c in keys}) if keys else rows
    # ties go to the leading source, then to the lowest values, so that reruns agree
    ties = [sortable(rows.schema[c]).asc_nulls_last() for c in (*names, *extras[0], rsrc)]
    order = Window.partitionBy(key).orderBy(F.col(ldts).asc_nulls_last(), F.col(source), *ties)
    first = rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank, source)
    if keys:
        first = first.select(*[unpacked(F.col(quoted(c))).alias(c) if c in keys else F.col(quoted(c)) for c in given if c != source])
    # ranked before known keys go: each task then sends one row of a key at most, however hot, and the join uses the same shuffle
    return facts.not_known(first, key) if incremental else first
