"""What a load must know of its target: high-water marks, for the whole target or by pattern, and the facts of its keys."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..functions.names import free
from ..specs import Kept
from .patterns import NO_ESCAPE, above_patterns, pattern_marks

#: Patterns beyond which they are matched by a join with the distinct record sources, not by an expression for each.
MANY = 32


def sentinel(value: str, like: DataFrame, column: str) -> Column:
    """A sentinel date in the type of a column."""
    return F.lit(value).cast(like.schema[column].dataType)


def like(text: Column, pattern: str) -> Column:
    return F.like(text, F.lit(pattern), F.lit(NO_ESCAPE))


def sql_like(text: str, pattern: str) -> bool:
    """LIKE between two strings of the plan."""
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def rows_of(target: DataFrame | Kept) -> DataFrame:
    return target.rows if isinstance(target, Kept) else target


class TargetFacts:
    """Marks of all patterns, the mark of the whole target, and the facts of its keys, from one aggregate over the target or,
    where they are kept, over its marks by record source.

    The error ghost's load date is in no mark.  Only the columns that are asked for are read.
    """

    def __init__(self, target: DataFrame | Kept, cfg: VaultConfig, *, whole: bool = False, patterns: Sequence[str] = (), key: str | None = None) -> None:
        self.target, self.key, self.patterns = rows_of(target), key, list(dict.fromkeys(patterns))
        kept = target.marks if isinstance(target, Kept) else None
        ldts, parts, self.marks = cfg.ldts_alias, [], None
        if len(self.patterns) > MANY:
            by_source = kept
            if kept is None:
                live = F.col(ldts) != sentinel(cfg.end_of_all_times, self.target, ldts)
                by_source = self.target.groupBy(cfg.rsrc_alias).agg(F.max(F.when(live, F.col(ldts))).alias(ldts))
            self.marks = pattern_marks(by_source, cfg.rsrc_alias, ldts, self.patterns)
            self.first = sentinel(cfg.beginning_of_all_times, self.target, ldts)
        elif whole or self.patterns:
            live = F.lit(True) if kept is not None else F.col(ldts) != sentinel(cfg.end_of_all_times, self.target, ldts)
            self.first = sentinel(cfg.beginning_of_all_times, self.target, ldts)
            parts += [F.max(F.when(live, F.col(ldts))).alias("mark")] if whole else []
            parts += [F.max(F.when(like(F.col(cfg.rsrc_alias), p) & live, F.col(ldts))).alias(f"p{i}") for i, p in enumerate(self.patterns)]
        if key and kept is not None:
            parts += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nulls")]
        elif key:
            parts += [F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")]
        self.row = (self.target if kept is None else kept).agg(F.struct(*parts).alias("facts")).scalar() if parts else None

    def above(self, load_date: Column, from_beginning: bool = True) -> Column:
        """load_date > the target's mark.  from_beginning: an empty target lets all rows pass; else none, as the mark is NULL."""
        mark = self.row.getField("mark")
        return load_date > (F.coalesce(mark, self.first) if from_beginning else mark)

    def passing(self, rows: DataFrame, record_source: str, load_date: str, patterns: Sequence[str]) -> DataFrame:
        """The rows of which passes() is true."""
        if self.marks is not None:
            return above_patterns(rows, record_source, load_date, patterns, self.marks, self.first)
        return rows.filter(self.passes(F.col(record_source), F.col(load_date), patterns))

    def passes(self, record_source: Column, load_date: Column, patterns: Sequence[str]) -> Column:
        """True for rows whose record source fits a pattern and whose load date is above that pattern's mark.

        The mark of a pattern is the highest of all patterns whose text it fits.
        """

        def branch(p: str) -> Column:
            marks = [self.row.getField(f"p{i}") for i, q in enumerate(self.patterns) if sql_like(q, p)]
            mark = F.greatest(*marks) if len(marks) > 1 else marks[0] if marks else F.lit(None)
            return like(record_source, p) & (load_date > F.coalesce(mark, self.first))

        return reduce(lambda a, b: a | b, map(branch, patterns))

    def not_known(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose key isn't in the target, as NOT IN has it: none if a key there is NULL; a NULL of the rows stays only
        if the target is empty.

        An ordinary anti join, which shuffles by key; a null-aware one would broadcast all keys.
        """
        (name,) = free(rows.columns, "_known")
        known = self.target.select(F.col(self.key).alias(name))
        n, nulls = self.row.getField("n"), self.row.getField("nulls")
        fresh = rows.join(known, F.col(column) == F.col(name), "left_anti")
        return fresh.filter((nulls == 0) & (F.col(column).isNotNull() | (n == 0)))
