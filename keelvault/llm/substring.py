"""Substring dedup with compressed FM-indexes, one per shard (operator 3).

A window is WINDOW consecutive words.  Its minimiser is the GRAM-word sequence in it with the smallest hash (the leftmost
of equal ones), so equal windows have the same minimiser at the same place.  Consecutive windows with one minimiser form a
piece.  Three passes:

1. Hashes of minimisers are counted over the corpus (a partial sum in each task first).  Those that occur once can't lie in
   a repeated window.  A bit map of a fixed size (FILTER_BITS) of the repeated ones is all that is broadcast; where it
   fills up, more pieces pass and the result stays the same.
2. Pieces with a repeated minimiser go to the shard of its hash.  Of equal pieces a task sends the words once, with the first
   place; the others of them repeat that one, in the same task, in all of their windows.  A minimiser with more than HOT
   occurrences (a second bit map) is cut into single windows, which go to the shards of their own hashes, so that no shard holds
   all contexts of a common passage.
3. A shard's distinct pieces are indexed, each with the number of its places.  All pieces are streamed against the index:
   backward search gives the matching statistics of their words, up to a window's length, of sequences that have more than one
   place.  Where they reach it, the window's occurrences are located, and it is repeated in all places but the earliest.

Repeated windows, as bit masks over pieces, are brought together by document and joined with the texts; words that they
cover go.  Windows are judged on the input, and a copy never depends on what happened to another.

Defined results: texts with fewer words than a window keep all words (null and empty texts have none); a null id comes
after all others; rows of equal id and text are one document (each keeps what the first does), and rows of equal id and
different texts are ordered by a hash of the text where place and id agree; extra columns are ignored; empty tables give
empty results.  Words are compared by 64 bits of hash, in sequences of WINDOW.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._filter import bit_map as row_map
from ._filter import parted
from ._store import stored
from ._text import gram_hashes, mix, text_slices, word_hashes, words
from .fm_index import FMIndex

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1
#: Bits of the maps of repeated and of hot minimisers, and the count from which one is hot.
FILTER_BITS, HOT_BITS, HOT = 26, 22, 2000
#: Pieces that a task holds before it sends them, and words in an index at most (beyond, a shard is indexed by parts of its keys).
HELD, INDEX_WORDS = 400_000, 1_500_000
LAST = np.iinfo(np.int64).max
#: Bytes of a word's hash that are sent.
WIDTH = 6


def minimisers(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, places, grams): starts of the windows inside documents, where each one's minimiser begins, and all gram hashes."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    grams = gram_hashes(h, GRAM)
    value, place, width = grams, np.arange(len(grams)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        width += step
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    return inside, place[inside], grams


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A fixed-size map of the hashes (column h), at most 2**(bits-6) numbers on the driver."""
    place = F.shiftrightunsigned("h", 64 - bits)
    found = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def in_map(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted_minimisers(docs: DataFrame) -> DataFrame:
    """h, n: how often each minimiser's hash occurs, one count for each of its places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in text_slices(batch.column(0)):
                starts, ends, first = words(data, off)
                owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
                _, place, grams = minimisers(word_hashes(data, starts, ends), owner)
                held.append(grams[np.unique(place)])
                size += len(held[-1])
                if size > 2 * HELD:
                    yield _counts(held)
                    held, size = [], 0
        yield _counts(held)

    return docs.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def pieces(docs: DataFrame, repeated, hot) -> DataFrame:  # noqa: ANN001
    """shard (a hash), words (their hashes, see packed; empty: surely repeated), doc_id, row, start, mask (a bit for each repeated window).

    docs: doc_id, row, text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(2)):
                starts, ends, first = words(data, off)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                h = word_hashes(data, starts, ends)
                window, place, grams = minimisers(h, owner)
                if not len(window):
                    continue
                keep = in_map(repeated.value, grams[place], FILTER_BITS)
                window, place = window[keep], place[keep]
                if not len(window):
                    continue
                single = in_map(hot.value, grams[place], HOT_BITS)
                begin = np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)] | single
                at = np.flatnonzero(begin)
                n = np.diff(np.r_[at, len(window)])
                start = window[at]
                prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
                whole = gram_hashes(h, WINDOW)
                # a piece's hash: its first and last window's (which cover it), its length
                content = mix(whole[start] * np.uint64(3) ^ mix(whole[start + n - 1] + n.astype(np.uint64)) ^ (prefix[start + n - 1 + WINDOW] - prefix[start]))
                shard = np.where(single[at], mix(whole[start] + np.uint64(5)), grams[place[at]])
                doc = owner[start]
                ids = batch.column(0).slice(a, b - a).fill_null(LAST).to_numpy()
                rows = batch.column(1).slice(a, b - a).to_numpy()
                size_of = n + WINDOW - 1
                flat = np.repeat(start - (np.cumsum(size_of) - size_of), size_of) + np.arange(int(size_of.sum()))
                held.append((shard, content, ids[doc], rows[doc], start - first[doc], n, h[flat]))
                size += len(start)
                if size > HELD:
                    yield from _sent(held)
                    held, size = [], 0
        yield from _sent(held)

    return docs.select("doc_id", "row", "text").mapInArrow(work, "shard int, words binary, doc_id long, row long, start int, mask int")


def _sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    shard, content, ids, rows, start, n, flat = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((rows, start, ids, content, shard))
    new = np.r_[True, (shard[by][1:] != shard[by][:-1]) | (content[by][1:] != content[by][:-1])]
    first = np.zeros(len(by), bool)
    first[by[new]] = True
    # rows of one document, repeated, share their place and aren't copies of each other
    lead = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = np.zeros(len(by), bool)
    same[by] = (ids[by] == ids[lead]) & (rows[by] == rows[lead]) & (start[by] == start[lead]) & ~new
    size = n + WINDOW - 1
    sent = np.where(first, size, 0)
    values = flat[np.repeat(first, size)]
    mask = np.where(first, 0, (1 << n) - 1)
    # surely repeated ones need no index: they are spread by their row
    shard = np.where(first, shard, mix(rows.view(np.uint64)))
    keep = np.flatnonzero(~same)
    # a shard's number only gathers what may be equal, so half of its bits do
    table = pa.RecordBatch.from_arrays([pa.array((shard >> np.uint64(32)).astype(np.uint32).view(np.int32)), packed(sent, values), pa.array(ids), pa.array(rows), pa.array(start.astype(np.int32)), pa.array(mask.astype(np.int32))], names=["shard", "words", "doc_id", "row", "start", "mask"])
    for a in range(0, len(keep), 20_000):
        yield table.take(pa.array(keep[a : a + 20_000]))


def packed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of hashes of the given sizes, as the WIDTH upper bytes of each: what they can't tell apart (a word in 2**48) would
    have to stand in windows that are equal otherwise."""
    flat = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :])
    offsets = np.r_[0, np.cumsum(sizes * WIDTH)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def unpacked(column: pa.Array) -> pa.ListArray:
    """The lists again, with zeros for the lower bytes."""
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if sizes.sum() else np.zeros(0, np.uint8)
    whole = np.zeros((len(flat) // WIDTH, 8), np.uint8)
    whole[:, 8 - WIDTH :] = flat.reshape(-1, WIDTH)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes // WIDTH)].astype(np.int32)), pa.array(whole.reshape(-1).view(np.int64)))


def judged(lists: pa.ListArray, ids: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A mask for each piece: the windows of it that also start earlier."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().view(np.uint64)
    mask = np.zeros(len(size), np.int64)
    # equal pieces are held, and streamed, once: with the number of their places and the earliest
    content = mix(np.add.reduceat(mix(flat ^ np.uint64(0x9E6C63D0876A9A47)) * _odd(size), np.cumsum(size) - size) + size.astype(np.uint64))
    by = np.lexsort((rows, start, ids, content))
    new = np.r_[True, content[by][1:] != content[by][:-1]]
    place = np.r_[True, (ids[by][1:] != ids[by][:-1]) | (start[by][1:] != start[by][:-1]) | (rows[by][1:] != rows[by][:-1])] | new
    which = np.empty(len(by), np.int64)  # the distinct piece of each
    which[by] = np.cumsum(new) - 1
    one, places = by[new], np.add.reduceat(place.astype(np.int64), np.flatnonzero(new))
    length = size[one]
    used = length + 1
    ends = np.cumsum(used)
    inner = np.ones(int(ends[-1]), bool)
    inner[ends - 1] = False
    at = np.repeat(np.cumsum(size)[one] - size[one] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    stream = flat[at] | np.uint64(1)
    text = np.zeros(len(inner), np.uint64)
    text[inner] = stream
    index = FMIndex(text, np.repeat(places, used))
    # windows end from the last word of the first one on
    n = length - WINDOW + 1
    piece = np.repeat(np.arange(len(one)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    last = (np.cumsum(length) - length)[piece] + offset + WINDOW - 1
    reach, low, high = index.matching(index.coded(stream), last, np.full(len(last), WINDOW))
    hit = np.flatnonzero(reach == WINDOW)
    if not len(hit):
        return mask
    # equal windows have one range of suffixes; others have disjoint ones
    lows, back = np.unique(low[hit], return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[back] = high[hit]
    count = highs - lows
    found = index.locate(np.repeat(lows - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
    of = np.searchsorted(ends, found, "right")
    begins = start[one][of] + found - (ends - used)[of]
    order = np.empty(len(found), np.int64)
    order[np.lexsort((rows[one][of], begins, ids[one][of]))] = np.arange(len(found))
    first = np.minimum.reduceat(order, np.cumsum(count) - count)
    winner = np.empty(len(found), np.int64)
    winner[order] = np.arange(len(found))
    best = winner[first][back]
    # every piece of that content, at each of the repeated windows
    many = np.bincount(which, minlength=len(one))
    begin = np.cumsum(many) - many
    grouped = np.argsort(which, kind="stable")
    times = many[piece[hit]]
    of_hit = np.repeat(np.arange(len(hit)), times)
    own = grouped[np.repeat(begin[piece[hit]] - (np.cumsum(times) - times), times) + np.arange(len(of_hit))]
    shift, best = offset[hit][of_hit], best[of_hit]
    later = (ids[own] != ids[one][of[best]]) | (start[own] + shift != begins[best]) | (rows[own] != rows[one][of[best]])
    np.bitwise_or.at(mask, own[later], 1 << shift[later])
    return mask


_ODD = np.ones(1, np.uint64)


def _odd(size: np.ndarray) -> np.ndarray:
    """A different odd factor for each place in a piece."""
    global _ODD
    most = int(size.max())
    if len(_ODD) < most:
        _ODD = mix(np.arange(most, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
    return _ODD[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the pieces of a partition, sorted by shard: as many shards at a time as an index may hold."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        key = batch.column(0).to_numpy()
        if held and size > INDEX_WORDS:
            # up to the end of the shard that the last batch left open
            same = int(np.searchsorted(key != last, True)) if len(key) else 0
            if same:
                held.append(batch.slice(0, same))
            if same < len(key):
                yield _judged(held)
                held, size, batch = [], 0, batch.slice(same)
            else:
                continue
        if batch.num_rows:
            held.append(batch)
            size += (pc.sum(pc.binary_length(batch.column(1))).as_py() or 0) // WIDTH
            last = batch.column(0)[-1].as_py()
    if held:
        yield _judged(held)


def _judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    ids, rows, start, mask = (table.column(i).to_numpy() for i in (2, 3, 4, 5))
    mask = mask.astype(np.int64)
    column = table.column(1)
    full = np.flatnonzero(np.asarray(pc.binary_length(column)) > 0)
    if len(full):
        mask[full] |= judged(unpacked(column.take(pa.array(full))), ids[full], rows[full], start[full].astype(np.int64))
    hit = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(rows[hit]), pa.array(start[hit]), pa.array(mask[hit].astype(np.int32))], names=["row", "start", "mask"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a blank), a row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")
    counts = stored(counted_minimisers(rows).filter("n > 1"), "minimisers")
    repeated = spark.sparkContext.broadcast(bit_map(counts, FILTER_BITS))
    hot = spark.sparkContext.broadcast(bit_map(counts.filter(F.col("n") > HOT), HOT_BITS))
    sharded = pieces(rows, repeated, hot).repartition("shard").sortWithinPartitions("shard")
    masks = sharded.mapInArrow(_shards, "row long, start int, mask int")
    by_row = stored(masks.groupBy("row").agg(F.collect_set(F.struct("start", "mask")).alias("found")), "repeated-windows")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            for a, b, data, off in text_slices(batch.column(1)):
                starts, ends, first = words(data, off)
                gone = np.zeros(len(starts) + 1, np.int64)
                some = found.slice(a, b - a)
                pairs = some.flatten()
                if len(pairs):
                    doc = np.repeat(np.arange(b - a), np.array(pc.fill_null(pc.list_value_length(some), 0)))
                    s, m = pairs.field(0).to_numpy().astype(np.int64) + first[doc], pairs.field(1).to_numpy()
                    for bit in range(SPAN):
                        at = s[(m >> bit & 1).astype(bool)] + bit
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + WINDOW, -1)
                keep = np.cumsum(gone)[:-1] <= 0
                owner = np.repeat(np.arange(b - a), np.diff(first))
                n_words, n_kept = np.diff(first), np.bincount(owner[keep], minlength=b - a)
                # kept words with a blank after each, but the last of a document
                st, size = starts[keep], (ends - starts)[keep] + 1
                begin = np.cumsum(size) - size
                flat = np.repeat(st - begin, size) + np.arange(int(size.sum()))
                out = data[np.minimum(flat, len(data) - 1)] if len(flat) else np.zeros(0, np.uint8)
                out[begin + size - 1] = 32
                length = np.bincount(owner[keep], size, minlength=b - a).astype(np.int64)
                cut = np.cumsum(length)
                drop = cut[n_kept > 0] - 1
                out = np.delete(out, drop)
                offsets = np.concatenate([[0], np.cumsum(length - (n_kept > 0))]).astype(np.int32)
                kept = pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    near, far = parted(rows, F.xxhash64("row"), row_map(by_row, F.xxhash64("row"), "touched-map"))  # texts without repeated windows aren't shuffled
    without = far.withColumn("found", F.lit(None).cast(by_row.schema["found"].dataType))
    joined = near.join(by_row, "row", "left").select("doc_id", "text", "found").unionByName(without.select("doc_id", "text", "found"))
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")
