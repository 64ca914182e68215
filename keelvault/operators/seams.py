"""The neighbour of each row within its key, where one key may have more rows than one task should sort.

Keys of more than ``hot_rows`` rows are cut into slices at splitters taken from a sample of their rows; all other keys are one
slice.  A window by key and slice finds the neighbours, and the edges, one row a slice, are carried over the seams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free, quoted
from ..functions.types import sortable
from ..sources.scratch import stored

#: Sampled rows of a hot key, and the most slices of one.
SAMPLES, SLICES = 4096, 256


def place_of(rows: DataFrame, order: Sequence[str]) -> Column:
    """One value that sorts as the columns do, ascending, NULL last."""
    fields = []
    for i, c in enumerate(order):
        value = sortable(rows.schema[c])
        fields += [value.isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*fields)


def hot_splitters(rows: DataFrame, key: str, place: Column, hot_rows: int) -> DataFrame:
    """key, splitters: the places at which each key of more than hot_rows rows is cut, about evenly."""
    one = rows.select(F.col(quoted(key)).alias("key"), place.alias("place"))
    hot = one.groupBy("key").count().filter(F.col("count") > hot_rows).select(F.col("key").alias("hot"), "count")
    every = F.greatest(F.lit(1), F.floor(F.col("count") / SAMPLES))
    some = one.join(hot, F.col("key").eqNullSafe(F.col("hot"))).filter(F.pmod(F.xxhash64("place"), every) == 0)
    # equal places are one sample
    sampled = some.groupBy("key", "count", "place").agg(F.lit(1).alias("one")).groupBy("key", "count").agg(F.sort_array(F.collect_list("place")).alias("places"))
    n, slices = F.size("places"), F.least(F.lit(SLICES), F.ceil(F.col("count") / hot_rows), F.size("places")).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(slices - 1, F.lit(1))), lambda i: F.get("places", F.floor(n * i / slices).cast("int")))
    return sampled.select("key", F.array_distinct(F.filter(cuts, lambda c: c.isNotNull())).alias("splitters"))


def slice_of(splitters: Column, place: Column) -> Column:
    """How many of the splitters (ascending) aren't above the place: by bisection, as every row of a hot key asks."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((SLICES - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(splitters, n + step - 1) <= place, n + step).otherwise(n))


def with_neighbour(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str, there: str, *, ahead: bool = False, hot_rows: int) -> DataFrame:
    """With ``name``, the value of the row before each (ahead: after it) in its key, and ``there``, whether there is such a row.

    The columns of ``order`` are ascending, NULL last.  The splitters and edges are written at once: a row a hot key, and one a
    slice of it.
    """
    hot, cuts, slice_, near, edge, at = free([*rows.columns, name, there], "_hot", "_cuts", "_slice", "_near", "_edge", "_at")
    splitters = stored(hot_splitters(rows, key, place_of(rows, order), hot_rows), "splitters").select(F.col("key").alias(hot), F.col("splitters").alias(cuts))
    cut = rows.join(splitters, F.col(quoted(key)).eqNullSafe(F.col(hot)), "left")
    place = place_of(rows, order)
    cut = cut.withColumn(slice_, F.when(F.col(cuts).isNull(), F.lit(0)).otherwise(slice_of(F.col(cuts), place)))
    held = F.struct(F.col(quoted(value)).alias("v"))
    outermost = F.min_by(held, place) if ahead else F.max_by(held, place)
    edges = cut.filter(F.col(cuts).isNotNull()).groupBy(F.col(quoted(key)).alias("key"), F.col(slice_).alias("slice")).agg(outermost.alias("own"))
    along = Window.partitionBy("key").orderBy("slice")
    carried = F.lead("own").over(along) if ahead else F.lag("own").over(along)
    edges = stored(edges.select("key", "slice", carried.alias("edge")).filter("edge IS NOT NULL"), "edges").select(F.col("key").alias(hot), F.col("slice").alias(at), F.col("edge").alias(edge))
    inside = Window.partitionBy(quoted(key), slice_).orderBy(*[sortable(rows.schema[c]).asc_nulls_last() for c in order])
    found = cut.drop(hot, cuts).withColumn(near, F.lead(held).over(inside) if ahead else F.lag(held).over(inside))
    found = found.join(edges, F.col(quoted(key)).eqNullSafe(F.col(hot)) & (F.col(slice_) == F.col(at)), "left")
    both = F.coalesce(F.col(near), F.col(edge))
    return found.select(*[F.col(quoted(c)) for c in rows.columns], both["v"].alias(name), both.isNotNull().alias(there))
