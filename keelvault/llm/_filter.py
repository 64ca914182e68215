"""A bit map of rows, joined by broadcast: it tells most rows that a later join won't find, so that their texts aren't shuffled.

The map has 2**ROW_BITS bits, whatever the number of rows, so what is broadcast is bounded: at most 2**(ROW_BITS - 6) numbers.
It only saves work: where it fills up, more rows take the way of the join, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

ROW_BITS = 24


def _place(h: Column) -> tuple[Column, Column]:
    """The number of the map in which a hash's bit lies, and the bit."""
    place = F.shiftrightunsigned(h, 64 - ROW_BITS)
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(63).cast("int")


def bit_map(rows: DataFrame, h: Column, name: str) -> DataFrame:
    """The map of the rows' hashes."""
    word, bit = _place(h)
    found = rows.select(word.alias("_word"), bit.alias("_bit"))
    return stored(found.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), name)


def parted(df: DataFrame, h: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be in the map, rows whose hash isn't), with the columns of ``df``."""
    word, bit = _place(h)
    marked = df.select("*", word.alias("_at"), bit.alias("_bit"))
    joined = marked.join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    there = F.coalesce(F.expr("shiftright(_bits, _bit) & 1L"), F.lit(0)) == 1
    own = [F.col(f"`{c}`") for c in df.columns]
    return joined.filter(there).select(*own), joined.filter(~there).select(*own)
