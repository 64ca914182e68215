"""Importance resampling towards a target distribution (operator 13).

Features are runs of words, hashed into buckets by crc32.  What a bucket says for the target is one integer, its gain; a
document's weight is the sum of its features' gains, looked up in one array.  Adding Gumbel noise that depends on the id alone
turns the weights into scores whose highest ones are a draw without replacement.

1. Counts of all buckets, over all documents and all target texts (numpy inside of Arrow batches; ``buckets`` rows reach the
   driver, whatever the data).
2. One pass scores the documents; ids, numbers and scores are kept, texts aren't.
3. Every task sorts its eligible rows into runs, equal rows as one with a count, cut into blocks and written.
4. Splitters, from a bounded sample of the blocks' first keys, cut all runs into ranges of keys; exact counts of the ranges tell
   each one's first rank, and in which range the draw ends.  Ranges below that aren't merged.
5. In each other range the pieces of the runs are merged by a tournament tree.  Spark sorts the pieces by their first key (on
   disk, if need be), so that a task holds only those that overlap the key at hand.  The last range stops at the exact number.

Bounds: a task holds ``run_rows`` rows or the open pieces of a range; the driver ``SAMPLE`` keys and a count for each range.  No
task gets more than about ``range_rows`` rows (more only beyond MOST_RANGES ranges), and a group of equal rows is one entry a run.

Defined results: null texts have no features, weight 0, and are not eligible; a null id counts as an empty one and comes last
among equal scores; equal keys are ordered by number of features; equal rows are ranked next to each other; an empty table gives
an empty result, an empty target makes rare features dear; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ._store import stored
from ._text import FOLD, text_slices, trimmed, words

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SALT = 10_000, 1, 20, 10, "2024"
#: Rows sorted at once, rows in a block, rows in a range; the most ranges, and keys that the driver sees to choose them.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, MOST_RANGES, SAMPLE = 65_536, 1024, 65_536, 16_384, 65_536
#: The most rows that one row of the merge stands for.
COPIES = 65_536
#: Bytes that part words, once A-Z are a-z.
PARTS = np.zeros(256, bool)
PARTS[0:0x30] = PARTS[0x3A:0x61] = PARTS[0x7B:0x80] = True
#: A word longer than this is hashed on its own.
LONG_WORD = 48

_FIELDS = ("score", "doc_id", "n_features", "weight")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each slice of ``data``: all slices move on by a byte at once."""
    lengths = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")
    big = int(np.searchsorted(-lengths[order], -LONG_WORD, "left"))
    for i in order[:big]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = order[big:]
    at, size = starts[short], lengths[short]
    crc, rising = out[short], size[::-1]
    for j in range(int(size[0]) if len(size) else 0):
        n = len(size) - int(np.searchsorted(rising, j, "right"))  # those longer than j come first
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    out[short] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run: (buckets of the features in order, the first feature of each document)."""
    data = FOLD[data]
    starts, ends, first = words(data, offsets, PARTS)
    yield (crc32s(data, starts, ends) % np.uint32(buckets)).astype(np.int64), first
    if longest < 2 or not len(starts):
        return
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1  # the words again, parted by one space
    line = np.full(int(begin[-1] + lengths[-1]), 32, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[within + np.repeat(begin, lengths)] = data[within + np.repeat(starts, lengths)]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(2, longest + 1):
        i = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        found = crc32s(line, begin[i], begin[i + k - 1] + lengths[i + k - 1])
        yield (found % np.uint32(buckets)).astype(np.int64), np.searchsorted(i, first)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for found, _ in features(data, offsets, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the log of how much likelier each bucket is in the target), counts raised by one."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """floor(1000 * Gumbel noise), from the id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, salt: str = SALT) -> DataFrame:
    """doc_id, n_features, n_words, weight, score: a row for each document."""
    buckets = len(gain)

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            weight, many, long = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b, data, offsets in text_slices(batch.column(1)):
                for k, (found, first) in enumerate(features(data, offsets, longest, buckets)):
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    weight[a:b] += sums[first[1:]] - sums[first[:-1]]
                    many[a:b] += np.diff(first)
                    if k == 0:
                        long[a:b] = np.diff(first)
            yield pa.record_batch([batch.column(0), pa.array(many), pa.array(long), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")
    return found.select("*", (F.col("weight") + noise(F.col("doc_id"), salt)).alias("score"))


# --- sorted runs and their merge -------------------------------------------------------------------------------------------


def keys_of(score: list, doc_id: list, *others: list) -> list[tuple]:
    """Keys that sort as the draw does: high scores first, null ids last."""
    return [(-s, i is None, 0 if i is None else i, *rest) for s, i, *rest in zip(score, doc_id, *others, strict=True)]


def _blocks(table: pa.Table, block_rows: int) -> pa.RecordBatch:
    """One sorted run of a table of rows, cut into blocks: the first row of each, and lists of its columns."""
    table = table.group_by(list(_FIELDS)).aggregate([([], "count_all")])
    order = pc.sort_indices(table, sort_keys=[("score", "descending"), *((c, "ascending") for c in _FIELDS[1:])], null_placement="at_end")
    table = table.take(order).combine_chunks()
    begins = np.arange(0, table.num_rows, block_rows)
    offsets = pa.array(np.append(begins, table.num_rows).astype(np.int32))
    flat = [table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in (*_FIELDS, "count_all")]
    firsts = [c.take(pa.array(begins)) for c in flat[:4]]
    return pa.record_batch([*firsts, *[pa.ListArray.from_arrays(offsets, c) for c in flat]], [*(f"first_{c}" for c in _FIELDS), *_FIELDS, "many"])


def sorted_runs(rows: DataFrame, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each task's rows in sorted runs of at most ``run_rows``; a row a block."""
    kinds = {c: rows.schema[c].dataType for c in _FIELDS}
    fields = [StructField(f"first_{c}", k) for c, k in kinds.items()] + [StructField(c, ArrayType(k)) for c, k in kinds.items()] + [StructField("many", ArrayType(LongType()))]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, run_rows):
                part = batch.slice(a, run_rows)
                if held and n + part.num_rows > run_rows:
                    yield _blocks(pa.Table.from_batches(held), block_rows)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield _blocks(pa.Table.from_batches(held), block_rows)

    return rows.select(*_FIELDS).mapInArrow(runs, StructType(fields))


def splitters(runs: DataFrame, ranges: int, sample: int = SAMPLE) -> list[tuple]:
    """At most ranges - 1 keys (score, id) that part the rows about evenly; only the balance of tasks depends on the sample."""
    heads = runs.select("first_score", "first_doc_id")
    n = heads.count()
    if ranges < 2 or not n:
        return []
    if n > sample:
        heads = heads.filter(F.pmod(F.xxhash64("first_score", "first_doc_id"), F.lit(-(-n // sample))) == 0)
    found = sorted(keys_of(*zip(*rows, strict=True))) if (rows := [tuple(r) for r in heads.distinct().collect()]) else []  # equal keys are one
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def ranged(runs: DataFrame, parts: list[tuple]) -> DataFrame:
    """The blocks cut at the splitters, with the number of their range, rows and first key."""
    schema = StructType([StructField("range", LongType()), StructField("rows", LongType()), *runs.schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(j)[i].values for j in range(4, 9)]
                keys = keys_of(lists[0].to_pylist(), lists[1].to_pylist())
                low, high = bisect_right(parts, keys[0]), bisect_right(parts, keys[-1])
                inner, a = [bisect_left_of(keys, parts[r]) for r in range(low, high)], 0
                for r, b in zip(range(low, high + 1), [*inner, len(keys)], strict=True):
                    if b > a:
                        own = [c.slice(a, b - a) for c in lists]
                        firsts = [c.slice(0, 1) for c in own[:4]]
                        nested = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c) for c in own]
                        yield pa.record_batch([pa.array([r]), pa.array([pc.sum(own[4]).as_py()]), *firsts, *nested], schema.names)
                    a = b

    return runs.mapInArrow(cut, schema)


def bisect_left_of(keys: list[tuple], key: tuple) -> int:
    """How many of the sorted keys are below ``key``."""
    low, high = 0, len(keys)
    while low < high:
        mid = (low + high) // 2
        if keys[mid] < key:
            low = mid + 1
        else:
            high = mid
    return low


class Tournament:
    """A winner tree over the next keys of the open pieces; places are added as pieces open."""

    OVER = (math.inf,)

    def __init__(self) -> None:
        self.size, self.keys, self.best, self.free = 1, [self.OVER], [0, 0], [0]

    def open(self, key: tuple) -> int:
        """The place of a new piece."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.keys += [self.OVER] * self.size
            self.size *= 2
            self.best = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self._play(node)
        place = self.free.pop()
        self.set(place, key)
        return place

    def set(self, place: int, key: tuple) -> None:
        self.keys[place] = key
        node = (place + self.size) >> 1
        while node:
            self._play(node)
            node >>= 1

    def close(self, place: int) -> None:
        self.set(place, self.OVER)
        self.free.append(place)

    def winner(self) -> int:
        return self.best[1]

    def _play(self, node: int) -> None:
        a, b = self.best[2 * node], self.best[2 * node + 1]
        self.best[node] = a if self.keys[a] <= self.keys[b] else b


def merged(pieces: Iterator[tuple[list[tuple], list[int]]]) -> Iterator[tuple[tuple, int]]:
    """(keys, counts) of sorted pieces, which come by their first key -> (key, count) in order.

    A piece is opened when its first key may be next, and closed at its end; a consumer that stops early leaves the rest unread.
    """
    tree, open_, ahead = Tournament(), {}, next(pieces, None)
    while ahead is not None or open_:
        while ahead is not None and (not open_ or ahead[0][0] <= tree.keys[tree.winner()]):
            place = tree.open(ahead[0][0])
            open_[place] = [*ahead, 0]
            ahead = next(pieces, None)
        place = tree.winner()
        keys, counts, i = open_[place]
        yield keys[i], counts[i]
        if i + 1 < len(keys):
            open_[place][2] = i + 1
            tree.set(place, keys[i + 1])
        else:
            del open_[place]
            tree.close(place)


def ranked(pieces: DataFrame, first_ranks: list[int], draws: int) -> DataFrame:
    """The merge of each range: doc_id, n_features, weight, score, rank (of the first; null: not drawn), many.

    first_ranks: the rank before the first of each range.
    """
    kinds = {c: pieces.schema[f"first_{c}"].dataType for c in _FIELDS}
    schema = StructType([*[StructField(c, kinds[c]) for c in ("doc_id", "n_features", "weight", "score")], StructField("rank", LongType()), StructField("many", LongType())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[int]]]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("range", *_FIELDS, "many")}
            for i in range(batch.num_rows):
                score, ids, many, weight, count = [batch.column(at[c])[i].as_py() for c in (*_FIELDS, "many")]
                yield batch.column(at["range"])[i].as_py(), keys_of(score, ids, many, weight), count

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def full(limit: int) -> Iterator[pa.RecordBatch]:
            if len(out) > limit:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out.clear()

        arrow = _arrow_schema(schema)
        for number, group in groupby(rows_of(batches), key=lambda r: r[0]):
            rank = first_ranks[number]
            for (score, missing, doc_id, many, weight), count in merged((keys, counts) for _, keys, counts in group):
                drawn = max(0, min(count, draws - rank))
                for a, b, taken in ((0, drawn, True), (drawn, count, False)):
                    for begin in range(a, b, COPIES):
                        n = min(COPIES, b - begin)
                        out.append((None if missing else doc_id, many, weight, -score, rank + begin + 1 if taken else None, n))
                rank += count
                yield from full(4095)
        yield from full(0)

    return pieces.mapInArrow(merge, schema)


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _from(key: tuple) -> Column:
    """Rows at or after a splitter."""
    low, missing, doc_id = -key[0], key[1], key[2]
    later = F.col("doc_id").isNull() if missing else F.col("doc_id").isNull() | (F.col("doc_id") >= F.lit(doc_id))
    return (F.col("score") < F.lit(low)) | ((F.col("score") == F.lit(low)) & later)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, salt: str = SALT, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents; of those with enough words, floor(percent * N / 100) have a rank.

    docs: doc_id, text; target: text.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = stored(scored(docs, gain, longest, salt).withColumn("eligible", F.col("n_words") >= least_words), "resample-scored")
    runs = stored(sorted_runs(rows.filter("eligible"), run_rows, block_rows), "resample-runs")
    total = runs.agg(F.sum(F.aggregate("many", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    draws = total * percent // 100
    parts = splitters(runs, min(MOST_RANGES, -(-total // range_rows)))
    pieces = ranged(runs, parts)
    counts = {r["range"]: r["n"] for r in pieces.groupBy("range").agg(F.sum("rows").alias("n")).collect()}
    first_ranks, before = [], 0
    for r in range(len(parts) + 1):
        first_ranks.append(before)
        before += counts.get(r, 0)
    last = max((r for r, b in enumerate(first_ranks) if b < draws), default=-1)
    columns = ["doc_id", "n_features", "weight", "score"]
    lone = rows.filter("NOT eligible" if last >= 0 else "true")
    if 0 <= last < len(parts):
        lone = rows.filter(~F.col("eligible") | _from(parts[last]))
    out = lone.select(*columns, F.lit(None).cast("long").alias("rank"))
    if last < 0:
        return out
    order = [F.col("range"), F.col("first_score").desc(), F.col("first_doc_id").asc_nulls_last(), "first_n_features", "first_weight"]
    dealt = pieces.filter(F.col("range") <= last).repartition(last + 1, "range").sortWithinPartitions(*order)
    done = stored(ranked(dealt, first_ranks, draws), "resample-ranks")
    # equal rows are one row of the merge; they are dealt out before they become many again
    several = done.filter("many > 1").repartition("rank", "many", "doc_id")
    several = several.select(*columns, "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("_i"))
    return out.unionByName(done.filter("many = 1").select(*columns, "rank")).unionByName(several.select(*columns, (F.col("rank") + F.col("_i")).alias("rank")))


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents that were drawn, with their columns and the rank (under a name that is free); ids must be unique."""
    name = "rank"
    while name in docs.columns:
        name += "_"
    found = ranks.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"), F.col("rank").alias("_rank"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(found, F.col("doc_id") == F.col("_drawn")).select(*own, F.col("_rank").alias(name))
