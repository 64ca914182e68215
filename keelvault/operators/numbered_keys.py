"""First loads of links over stages that aren't computed yet: rows are ranked by the whole numbers that their keys are hashes of,
and only those that stay are hashed.

A whole number and its text in a hash correspond one to one, whatever the settings of case and trimming; so rows have one link
key if and only if they have the same numbers (and NULLs).  A row then travels as a few numbers, not as its hash keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from ..config import VaultConfig
from ..functions.hashing import hash_expr
from ..functions.names import free, quoted
from ..functions.types import sortable
from ..specs import Binding, HashRule, StageSpec
from .stage import stage


def first_by_numbers(sources: Sequence[Binding], key: str, names: Sequence[str], columns: Sequence[Sequence[str]], extras: Sequence[str], cfg: VaultConfig) -> DataFrame | None:
    """The earliest row of each key, as the operator has it; None where it needs staged rows: a source isn't a StageSpec, or has
    a sequence or ghost rows, a key isn't a hash of whole numbers, or foreign keys aren't hashes of the link key's inputs.

    What all bindings of a stage share stays outside of their structs, so that a table that is dealt out by it isn't shuffled again.
    """
    ldts, rsrc = cfg.ldts_alias, cfg.rsrc_alias
    raws: dict[int, DataFrame] = {}
    inputs, places = [], []
    for b, own in zip(sources, columns, strict=True):
        spec = b.source
        if not isinstance(spec, StageSpec) or not spec.include_source_columns or spec.sequence or spec.ghost_record_types:
            return None
        if id(spec) not in raws:
            raws[id(spec)] = stage(replace(spec, hashed_columns={}, missing_columns={}), cfg=cfg)
        df, made = raws[id(spec)], {c.lower() for c in (*spec.hashed_columns, *spec.missing_columns)}
        given = [*extras, b.load_date_col or ldts, b.record_source_col or rsrc]
        if made & {c.lower() for c in df.columns} or not set(given) <= set(df.columns):
            return None
        keys = [b.hash_key_col or key, *own]
        if not set(keys) <= spec.hashed_columns.keys():
            return None
        of_key, *of_names = [list(HashRule.of(spec.hashed_columns[c]).columns) for c in keys]
        if not all(of_names) or any(set(rule) - set(of_key) for rule in of_names):
            return None
        if not set(of_key) <= set(df.columns) or not all(isinstance(df.schema[c].dataType, IntegralType) for c in of_key):
            return None
        inputs.append(of_key)
        places.append([[of_key.index(c) for c in rule] for rule in of_names])
    if any(p != places[0] for p in places) or len({len(i) for i in inputs}) > 1:
        return None
    source, rank, *numbers = free([key, *names, *extras, ldts, rsrc], "_source", "_rank", *[f"_number{i}" for i in range(len(inputs[0]))])
    order = [*numbers, *extras, ldts, rsrc]

    def column(df: DataFrame, name: str, raw: str) -> Column:
        whole = name in numbers and not isinstance(df.schema[raw].dataType, LongType)
        return (F.col(quoted(raw)).cast("long") if whole else F.col(quoted(raw))).alias(name)

    groups: dict[int, list[int]] = {}
    for i, b in enumerate(sources):
        groups.setdefault(id(b.source), []).append(i)
    rows = None
    for spec, members in groups.items():
        df = raws[spec]
        shaped = [dict(zip(order, [*inputs[i], *extras, sources[i].load_date_col or ldts, sources[i].record_source_col or rsrc], strict=True)) for i in members]
        shared = [n for n in order if len({s[n] for s in shaped}) == 1]
        structs = [F.struct(*[column(df, n, s[n]) for n in order if n not in shared], F.lit(i).alias(source)) for i, s in zip(members, shaped, strict=True)]
        read = df.select(*[column(df, n, shaped[0][n]) for n in shared], F.inline(F.array(*structs)))
        rows = read if rows is None else rows.unionByName(read)

    ties = [sortable(rows.schema[c]).asc_nulls_last() for c in (*extras, rsrc)]  # the foreign keys of one key are the same
    ranked = Window.partitionBy(*map(quoted, numbers)).orderBy(F.col(quoted(ldts)).asc_nulls_last(), F.col(source), *ties)
    first = rows.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) == 1)
    hashed = [hash_expr([F.col(quoted(numbers[p])) for p in of], cfg).alias(n) for n, of in zip((key, *names), (range(len(numbers)), *places[0]), strict=True)]
    return first.select(*hashed, *[F.col(quoted(c)) for c in (*extras, ldts, rsrc)])
