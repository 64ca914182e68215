"""What an operator is told about its sources: plain frozen values, checked when made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .sources.tables import TableRef

Source = DataFrame | TableRef | str


@dataclass(frozen=True)
class HashRule:
    """Columns that are hashed together; None leaves a choice to the stage, then to the settings."""

    columns: Sequence[str]
    is_hashdiff: bool = False
    case_sensitivity: bool | None = None
    use_rtrim: bool | None = None
    #: Whether a None was stated, which passes over the stage's choice.
    stated: frozenset[str] = frozenset()

    @classmethod
    def of(cls, rule: HashRule | Mapping | Sequence[str]) -> HashRule:
        """From a list of columns (a hash key), or a mapping with columns, is_hashdiff, case_sensitivity, use_rtrim."""
        if isinstance(rule, HashRule):
            return rule
        if isinstance(rule, Mapping):
            return cls(tuple(rule.get("columns", ())), rule.get("is_hashdiff", False), rule.get("case_sensitivity"), rule.get("use_rtrim"), frozenset(rule))
        return cls(tuple(rule))

    def choice(self, name: str, of_stage: bool | None) -> bool | None:
        """The rule's own choice if it states one (even None), else the stage's."""
        own = getattr(self, name)
        return own if own is not None or name in self.stated else of_stage


@dataclass(frozen=True)
class StageSpec:
    """A raw table and how it is staged."""

    source: Source
    load_date_col: str | None = None
    record_source_col: str | None = None
    hashed_columns: Mapping[str, HashRule | Mapping | Sequence[str]] = field(default_factory=dict)
    derived_columns: Mapping[str, str] = field(default_factory=dict)
    include_source_columns: bool = True
    case_sensitivity: bool | None = None
    use_rtrim: bool | None = None
    missing_columns: Mapping[str, str] = field(default_factory=dict)
    ghost_record_types: Mapping[str, str] = field(default_factory=dict)
    sequence: str | None = None
    #: Columns that order the sequence; the values of all columns by default.
    sequence_order: Sequence[str] = ()


@dataclass(frozen=True)
class Binding:
    """How an entity reads one staged table.  Key columns map by position to the entity's own names.

    Hubs and links also take a StageSpec, which they stage themselves.
    """

    source: Source | StageSpec
    load_date_col: str | None = None
    record_source_col: str | None = None
    bk_columns: Sequence[str] | None = None
    fk_columns: Sequence[str] | None = None
    hash_key_col: str | None = None
    payload: Sequence[str] = ()
    rsrc_statics: Sequence[str] = ()
    additional_columns: Sequence[str] = ()


@dataclass(frozen=True)
class Kept:
    """A target whose facts are kept beside its rows, so that a load needn't scan them.

    marks: by record source the latest load date (under the settings' names), number of rows n and of NULL keys nulls.
    states: by parent the load date and hash diff of its latest row.
    """

    rows: DataFrame
    marks: DataFrame | None = None
    states: DataFrame | None = None
