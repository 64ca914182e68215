"""Marks of many record-source patterns: patterns are matched once per distinct record source, not once per row.

A pattern's literal beginning, up to its first wildcard, is a key: a source is joined with all patterns whose beginning is one of
its own prefixes (of the few lengths that beginnings have), and LIKE decides the rest.  So neither the plan nor the work on a row
grows with the number of patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free, quoted

#: An escape character that no pattern holds, so that a backslash stands for itself.
NO_ESCAPE = "\u0001"


def beginning(pattern: str) -> str:
    """What every text that fits begins with."""
    return pattern[: min((i for i in (pattern.find("%"), pattern.find("_")) if i >= 0), default=len(pattern))]


def fitting(texts: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """text, pattern: all pairs of a text of the column (which should be distinct) and a pattern that it fits."""
    spark, distinct = texts.sparkSession, list(dict.fromkeys(patterns))
    known = spark.createDataFrame([(p, beginning(p)) for p in distinct], "pattern string, beginning string")
    lengths = F.array(*map(F.lit, sorted({len(beginning(p)) for p in distinct})))
    text = F.col(quoted(column))
    prefixes = texts.select(text.alias("text"), F.explode(F.filter(lengths, lambda n: n <= F.char_length(text))).alias("n"))
    prefixes = prefixes.select("text", F.substring(F.col("text"), F.lit(1), F.col("n")).alias("prefix"))
    return prefixes.join(known, F.col("prefix") == F.col("beginning")).filter(F.like(F.col("text"), F.col("pattern"), F.lit(NO_ESCAPE))).select("text", "pattern")


def pattern_marks(marks: DataFrame, record_source: str, load_date: str, patterns: Sequence[str]) -> DataFrame:
    """pattern, mark: for each pattern the latest load date of the sources that fit it or a pattern whose text fits it.

    marks: record source and its latest load date.
    """
    spark = marks.sparkSession
    own = fitting(marks, record_source, patterns).join(marks.select(F.col(quoted(record_source)).alias("source"), F.col(quoted(load_date)).alias("mark")), F.col("text") == F.col("source"))
    own = own.groupBy("pattern").agg(F.max("mark").alias("mark"))
    texts = spark.createDataFrame([(p,) for p in dict.fromkeys(patterns)], "given string")
    wider = fitting(texts, "given", patterns).select(F.col("text").alias("narrow"), F.col("pattern").alias("wide"))
    found = own.join(wider, F.col("pattern") == F.col("narrow")).groupBy("wide").agg(F.max("mark").alias("mark"))
    return found.select(F.col("wide").alias("pattern"), "mark")


def above_patterns(rows: DataFrame, record_source: str, load_date: str, patterns: Sequence[str], marks: DataFrame, first: object) -> DataFrame:
    """The rows whose record source fits one of the patterns and whose load date is above that pattern's mark.

    marks: pattern, mark (of pattern_marks); first: the mark of a pattern that has none.
    """
    (source, least) = free(rows.columns, "_source", "_least")
    sources = rows.select(quoted(record_source)).distinct()
    fits = fitting(sources, record_source, patterns).join(marks.withColumnRenamed("pattern", "known"), F.col("pattern") == F.col("known"), "left")
    limits = fits.groupBy(F.col("text").alias(source)).agg(F.min(F.coalesce("mark", first)).alias(least))
    joined = rows.join(limits, F.col(quoted(record_source)) == F.col(source)).filter(F.col(quoted(load_date)) > F.col(least))
    return joined.select(*map(quoted, rows.columns))
