"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 7).

Each document draws an exponential key scaled by its quality weight; within a source the documents are taken in key
order until the source's token budget is met.  Complete epochs come first: a source whose target exceeds its size takes
every document whole as often as it fits, and only the rest is selected by key.

Distribution: no source is ever put in order.  The place where its budget ends is found by three passes over a small table
of keys and sizes: sums of 4,096 ranges of keys give the range of the budget's end, sums of 4,096 parts of that range give
its part, and only the rows of that part (a sixteen-millionth of the keys) are sorted.  What comes of it is one row a source,
with the key, id and tie at which its budget ends.  Every document is then taken or left by comparing its own key with that
row, in one pass over the texts, which are never shuffled.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own and comes
last; equal keys (repeated ids) are ordered by id, then by a hash of the text; rows equal in all of these share what is due
to them equally, rounded down; an empty table gives an empty result; extra columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

#: Source weights, repeating over the sources in code-point order.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes, and the most of one source, in times its size.
SHARE, MOST = 1.5, 2
#: Ranges of keys, and parts of the range at which a budget ends.
KEY_BINS = 4096
#: With more sources than this, their rows are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
ODD = r"[^\p{L}\x09-\x0D\x20]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: a quarter, and three quarters of the share of letters and white space."""
    n = F.char_length(text)
    return F.when(n > 0, 0.25 + 0.75 * (n - F.regexp_count(text, F.lit(ODD))) / n).otherwise(F.lit(0.25))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone, so that reruns agree."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: the level is found at which the targets min(most * size, level * weight) sum to the share.

    It equals sharing by weight, capping, and sharing the excess by weight again until none is above.  One row a source.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(all_rows))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    chosen = F.coalesce(F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(all_rows), F.lit(0.0))
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), chosen * F.col("weight")).alias("target"))


def keyed(docs: DataFrame, carry: list[str], seed: int, weight: Column | None) -> DataFrame:
    """doc_id, source, _carried_*, _size, _key (smallest first), _tie, a row per document."""
    text = F.col("text")
    w = quality_weight(text) if weight is None else weight
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(text).alias("_size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / w).alias("_key"),
        F.xxhash64(text).alias("_tie"),
        *[F.col(c).alias(f"_carried_{c}") for c in carry],
    )


def with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """The rows with the columns of their source; few: those are broadcast."""
    sources = sources.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def ends_in(sums: DataFrame, due: DataFrame, few: bool) -> DataFrame:
    """sums: source, _at, _sum; due: source, _rest.  For each source the _at (by its order) at which _rest ends, and what of
    _rest is due there."""
    up_to = Window.partitionBy("source").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_sources(sums.withColumn("_up_to", F.sum("_sum").over(up_to)), due, few).filter("_up_to > _rest")
    end = F.min_by(F.struct(F.col("_at").alias("_end"), (F.col("_rest") - F.col("_up_to") + F.col("_sum")).alias("_rest")), "_at")
    return placed.groupBy("source").agg(end.alias("e")).select("source", "e._end", "e._rest")


def limits(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """targets with _last: the key, id and tie at which each source's _rest ends (null: nowhere), the words due there, and how
    many rows share them."""
    fine = F.floor(KEY_BINS * KEY_BINS * (1 - F.exp(-0.5 * F.col("_key"))))
    fine = F.least(F.lit(KEY_BINS * KEY_BINS - 1), fine).cast("int")
    rows = rows.withColumn("_bin", F.shiftright(fine, 12)).withColumn("_part", fine.bitwiseAND(KEY_BINS - 1))
    bins = stored(ends_in(rows.groupBy("source", F.col("_bin").alias("_at")).agg(F.sum("_size").alias("_sum")), targets.select("source", "_rest"), few), "mix-bins")
    near = with_sources(rows, bins, few).filter("_bin = _end").drop("_end", "_rest")
    parts = stored(ends_in(near.groupBy("source", F.col("_part").alias("_at")).agg(F.sum("_size").alias("_sum")), bins.select("source", "_rest"), few), "mix-parts")
    last = with_sources(near, parts, few).filter("_part = _end").drop("_end", "_rest")
    # rows equal in key, id and tie count as one
    last = last.groupBy("source", F.struct("_key", "doc_id", "_tie").alias("_at")).agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_many"))
    ends = with_sources(ends_in(last.drop("_many"), parts.select("source", "_rest"), few).withColumnRenamed("_rest", "_due"), last.select("source", F.col("_at").alias("_own"), "_many"), False)
    ends = ends.filter("_end = _own").select(F.col("source").alias("_o"), F.struct("_end", "_due", "_many").alias("_last"))
    return targets.join(ends, F.col("source").eqNullSafe(F.col("_o")), "left").drop("_o")


def _mixed(docs: DataFrame, carry: list[str], seed: int, weight: Column | None) -> DataFrame:
    """Columns doc_id, source, _carried_*, _size, _source_size, _target, _taken."""
    rows = stored(keyed(docs, [], seed, weight), "mix-keys")
    targets = source_targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_epochs", epochs).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    placed = with_sources(keyed(docs, carry, seed, weight) if carry else rows, stored(limits(rows, targets, few), "mix-limits"), few)
    own, end = F.struct("_key", "doc_id", "_tie"), F.col("_last._end")
    # without an end nothing of the source is left out
    selected = F.when(F.col("_last").isNull(), F.least(F.col("_size"), F.col("_rest"))).when(own < end, F.col("_size")).when(own == end, F.floor(F.col("_last._due") / F.col("_last._many"))).otherwise(0)
    return placed.select(
        "doc_id",
        "source",
        *[f"_carried_{c}" for c in carry],
        "_size",
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        (F.col("_epochs") * F.col("_size") + selected).cast("long").alias("_taken"),
    )


def mix(docs: DataFrame, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    weight: a positive quality weight for each row; quality_weight() of the text by default.
    """
    return _mixed(docs, [], seed, weight).select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def apply_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, a row for each time a document is taken.

    The one document of a source at which its budget ends is cut after the words still due.
    """
    own = docs.columns
    carry = [c for c in own if c not in ("doc_id", "source")]
    mixed = _mixed(docs, carry, seed, None).filter(F.col("_taken") > 0)
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    part = (F.col("_taken") - whole * F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.col("_size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    mixed = mixed.withColumn("_words", F.explode(copies))
    text, complete = F.col("_carried_text"), F.col("_words") == F.col("_size")
    cut = F.when(complete, text).otherwise(F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("_words"))))
    out = {"doc_id": F.col("doc_id"), "source": F.col("source")} | {c: F.col(f"_carried_{c}") for c in carry} | {"text": cut}
    if "n_chars" in own:
        out["n_chars"] = F.when(complete, out["n_chars"]).otherwise(F.char_length(cut).cast(docs.schema["n_chars"].dataType))
    return mixed.select(*[out[c].alias(c) for c in own])
