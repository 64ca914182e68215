"""MinHash near-duplicates: one-permutation hashing with optimal densification (operator 9).

A document's set holds the hashes of its distinct word shingles.  Its range of hash values is cut into BANDS * ROWS bins;
the smallest hash of each bin is one value of the signature, and an empty bin takes the value of another bin that a fixed
sequence of its own names (optimal densification).  ROWS values make a band, and equal bands make a bucket.

Equal sets are one node from the start.  In a bucket the node of the smallest id is the centre, and each other node is paired
with it only (star-shaped candidates), so the number of pairs is that of the members.  A pair is confirmed on the full sets.
A link between two nodes that aren't linked to a centre isn't lost: in a bucket whose nodes aren't of one component yet, the
nodes outside its largest component are compared with all of other components, block by block inside tasks, by a gate of GATE
bytes, and only pairs that pass are confirmed on the full sets.  Sets of up to SMALL shingles pass by a bit map that bounds the
size of the intersection from above, so no link of theirs is lost there; larger ones by a sketch of one-permutation values.

The chance that a pair at the threshold shares no bucket is (1 - 0.8**ROWS)**BANDS, about 5 in a million.

Defined results: texts without words are empty sets, linked with nothing; a row with a null id is linked with nothing and
has a null component; rows that repeat an id are one document for each different text; extra columns are ignored; an
empty table gives an empty result.  Sets are told apart by 128 bits and nodes numbered by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._filter import bit_map, parted
from ._graph import components
from ._store import stored
from ._text import _BASE, gram_hashes, mix, text_slices, trimmed, word_hashes, words

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Similarity from which documents are linked, in per cent, and words in a shingle, unless a caller says otherwise.
SIMILAR, WORDS = 80, 5
#: For each attempt, the bin whose value an empty bin takes.
ATTEMPTS = np.random.default_rng(4242).integers(0, BINS, (96, BINS))
#: Bytes of a gate, by which pairs across components are told apart before they are confirmed.
GATE_BITS = 9
GATE = 1 << GATE_BITS
#: Shingles of a set whose gate is a bit map.  Of a larger one it is a sketch: at the threshold's similarity the share of equal
#: bytes lies SIGMAS standard deviations above the least that is let through (all GATE values are drawn from so many shingles).
SMALL, SIGMAS = 1024, 4.5
ATTEMPTS_GATE = np.random.default_rng(4343).integers(0, GATE, (96, GATE))
#: Nodes of a bucket in a block; blocks are compared two by two, in tasks of their own.
BLOCK = 256
#: With more buckets of over a block, they are joined by a shuffle instead of a broadcast.
BROADCAST_BUCKETS = 200_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each document's begin."""
    starts, ends, first = words(data, off)
    h = word_hashes(data, starts, ends, fold=True)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(h, k)
    inside = owner[: len(grams)] == owner[k - 1 :] if len(grams) else np.zeros(0, bool)
    value, who = [grams[inside]], [owner[: len(grams)][inside]]
    for size in range(1, k):  # the whole sequence of a shorter document
        some = np.flatnonzero(n == size)
        if len(some):
            whole = h[first[some]]
            for j in range(1, size):
                whole = whole * _BASE + h[first[some] + j]
            value.append(mix(whole + np.uint64(1000 + size)))
            who.append(some)
    v, w = np.concatenate(value), np.concatenate(who)
    by = np.lexsort((v, w))
    v, w = v[by], w[by]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    v, w = v[new], w[new]
    return v, np.searchsorted(w, np.arange(len(n) + 1))


def bands(v: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band hashes of the non-empty sets, a row each."""
    n = np.diff(begin)
    full = np.flatnonzero(n)
    owner = np.repeat(np.arange(len(full)), n[full])
    bin_of = ((v >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    slot = owner * BINS + bin_of
    lowest = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    taken = np.zeros((len(full), BINS), bool)
    values = np.zeros((len(full), BINS), np.uint64)
    taken.ravel()[slot[lowest]] = True
    values.ravel()[slot[lowest]] = mix(v[lowest])
    row, col = np.nonzero(~taken)
    for attempt in ATTEMPTS:
        if not len(row):
            break
        other = attempt[col]
        hit = taken[row, other]
        values[row[hit], col[hit]] = values[row[hit], other[hit]]
        row, col = row[~hit], col[~hit]
    if len(row):  # very small sets: the next bin, round about, that isn't empty
        place = np.where(taken, np.arange(BINS), BINS * 2)
        ahead = np.minimum.accumulate(np.concatenate([place, place + BINS], 1)[:, ::-1], 1)[:, ::-1]
        values[row, col] = values[row, ahead[row, col] % BINS]
    out = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * _BASE + values[:, r::ROWS])
    return out


def bit_maps(v: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A map of 8 * GATE bits of each non-empty set (by another hash than the bands): two sets have no more shingles in common
    than bits, and than one of them has shingles that share a bit."""
    n = np.diff(begin)
    owner = np.repeat(np.arange((n > 0).sum()), n[n > 0])
    place = (mix(v ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - GATE_BITS - 3)).astype(np.int64)
    out = np.zeros(((n > 0).sum(), GATE), np.uint8)
    np.bitwise_or.at(out, (owner, place >> 3), np.uint8(1) << (place & 7).astype(np.uint8))
    return out


def sketches(v: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash in each of GATE bins, a row for each non-empty set (by another hash than the bands)."""
    n = np.diff(begin)
    full = np.flatnonzero(n)
    owner = np.repeat(np.arange(len(full)), n[full])
    h = mix(v ^ np.uint64(0x1F83D9ABFB41BD6B))
    slot = owner * GATE + (h >> np.uint64(64 - GATE_BITS)).astype(np.int64)
    by = np.lexsort((h, slot))
    slot, h = slot[by], h[by]
    lowest = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    out, taken = np.zeros((len(full), GATE), np.uint8), np.zeros((len(full), GATE), bool)
    out.ravel()[slot[lowest]] = (mix(h[lowest]) >> np.uint64(56)).astype(np.uint8)
    taken.ravel()[slot[lowest]] = True
    row, col = np.nonzero(~taken)
    for attempt in ATTEMPTS_GATE:
        if not len(row):
            break
        hit = taken[row, attempt[col]]
        out[row[hit], col[hit]] = out[row[hit], attempt[col[hit]]]
        row, col = row[~hit], col[~hit]
    return out


def gates(v: np.ndarray, begin: np.ndarray, similar: int) -> list[bytes]:
    """Of each non-empty set: its bit map if it has at most SMALL shingles, and its sketch if it is so large that it may be
    similar to one of more."""
    n = np.diff(begin)
    n = n[n > 0]
    maps, drawn = n <= SMALL, 100 * n > similar * SMALL
    out = [b""] * len(n)
    for some, make in ((maps, bit_maps), (drawn, sketches)):
        if not some.any():
            continue
        keep = np.repeat(some, n)
        made = make(v[keep], np.concatenate([[0], np.cumsum(n[some])]))
        for i, row in zip(np.flatnonzero(some), made, strict=True):
            out[i] += row.tobytes()
    return out


def passing(n: np.ndarray, gate: list[bytes], similar: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two lists of sets: which pairs may be similar enough, as a matrix."""
    share = similar / 100
    least = int(np.ceil(GATE * (share - SIGMAS * np.sqrt(share * (1 - share) / GATE))))
    small, drawn = n <= SMALL, 100 * n > similar * SMALL
    maps, drawn_bytes = np.zeros((len(n), GATE // 8), np.uint64), np.zeros((len(n), GATE), np.uint8)
    for i, g in enumerate(gate):
        if small[i]:
            maps[i] = np.frombuffer(g[:GATE], np.uint64)
        if drawn[i]:
            drawn_bytes[i] = np.frombuffer(g[-GATE:], np.uint8)
    shared_bits = n - np.bitwise_count(maps).sum(1, dtype=np.int64)  # shingles without a bit of their own

    def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(y)), bool)
        p, q = np.flatnonzero(small[x]), np.flatnonzero(small[y])
        if len(p) and len(q):
            a, b = x[p], y[q]
            most = np.bitwise_count(maps[a][:, None] & maps[b][None]).sum(2, dtype=np.int64) + np.minimum(shared_bits[a][:, None], shared_bits[b][None])
            out[np.ix_(p, q)] = (100 + similar) * most >= similar * (n[a][:, None] + n[b][None])
        p, q = np.flatnonzero(drawn[x]), np.flatnonzero(drawn[y])
        if len(p) and len(q):
            a, b = x[p], y[q]
            near = (drawn_bytes[a][:, None] == drawn_bytes[b][None]).sum(2, dtype=np.uint16) >= least
            both = small[a][:, None] & small[b][None]
            out[np.ix_(p, q)] = np.where(both, out[np.ix_(p, q)], near)
        return out

    return pairs


def numbers(v: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that stand for each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v + np.uint64(salt)))]) for salt in (11, 23)]
    return tuple(mix(s[begin[1:]] - s[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64) for s in sums)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, check (numbers of the set), bands (none for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1)):
                v, begin = shingle_sets(data, off, k)
                n = np.diff(begin)
                one, two = numbers(v, begin)
                rows = np.cumsum(np.where(n > 0, BANDS, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, rows].astype(np.int32)), pa.array(bands(v, begin).view(np.int64).ravel()))
                own = [batch.column(i).slice(a, b - a) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), lists], names=["doc_id", "text_hash", "n_shingles", "node", "check", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(trimmed(work), "doc_id long, text_hash long, n_shingles long, node long, check long, bands array<long>")


def full_sets(rows: DataFrame, k: int, similar: int) -> DataFrame:
    """rows: node, text.  Returns node, n, shingles (sorted 64-bit hashes as bytes) and gate where the text's set has that number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, off in text_slices(batch.column(1)):
                v, begin = shingle_sets(data, off, k)
                n = np.diff(begin)
                own = np.flatnonzero((numbers(v, begin)[0] == node[a:b]) & (n > 0))
                place, gate = np.cumsum(n > 0) - 1, gates(v, begin, similar)
                columns = [pa.array(node[a:b][own]), pa.array(n[own].astype(np.int64)), pa.array([v[begin[i] : begin[i + 1]].tobytes() for i in own], pa.binary()), pa.array([gate[place[i]] for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "shingles", "gate"])

    return rows.select("node", "text").mapInArrow(trimmed(work), "node long, n long, shingles binary, gate binary")


def dealt(members: DataFrame) -> DataFrame:
    """members: bucket, node, component.  Returns place, node, component, left, right: where each node of a bucket with several
    components is compared, and on which sides.

    A bucket of up to BLOCK nodes is one place.  In a larger one the nodes outside its largest component are cut into blocks and
    compared with each other and with that component's blocks, which are not compared among themselves.  The few large buckets
    are told apart first, so that none of them is dealt by its key.
    """
    by_part = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_part.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("most"))
    sizes = stored(sizes.filter("parts > 1 AND n > 2").select("bucket", "n", F.col("most.component").alias("main"), F.col("most.n").alias("n_main")), "open-buckets")
    large = sizes.filter(F.col("n") > BLOCK)
    hint = F.broadcast if large.count() <= BROADCAST_BUCKETS else lambda df: df
    rest = members.join(hint(large.select("bucket")), "bucket", "left_anti")
    one = rest.join(sizes.filter(F.col("n") <= BLOCK).select("bucket"), "bucket").select(F.xxhash64("bucket").alias("place"), "node", "component", F.lit(True).alias("left"), F.lit(True).alias("right"))
    wide = members.join(hint(large), "bucket")
    others, mains = (F.ceil(c / BLOCK).cast("int") for c in (F.col("n") - F.col("n_main"), F.col("n_main")))
    is_main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(is_main, mains).otherwise(others)).cast("int")
    wide = wide.withColumn("others", others).withColumn("mains", mains).withColumn("is_main", is_main).withColumn("block", block)
    # places are (block of the others, block of the others) or (block of the others, block of the largest component)
    across = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("kind"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"), F.lit(0).alias("kind"), (F.col("block") <= j).alias("left"), (F.col("block") >= j).alias("right")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(1).alias("kind"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    wide = wide.withColumn("at", F.explode(F.when(F.col("is_main"), across).otherwise(F.concat(among, with_main))))
    return one.unionByName(wide.select(F.xxhash64("bucket", "at.i", "at.j", "at.kind").alias("place"), "node", "component", "at.left", "at.right"))


def crossing(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """members: bucket, node, component.  Returns pairs (a, b) of different components that pass the gate; the other pairs are
    compared, but never written."""
    placed = dealt(members).join(sets.select("node", "n", "gate"), "node").repartition("place").sortWithinPartitions("place")

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node, component, left, right, n = (table[c].to_numpy() for c in ("node", "component", "left", "right", "n"))
        pairs = passing(n, table["gate"].to_pylist(), similar)
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        one, two = [], []
        step = max(1, (16 << 20) // (GATE * max(1, len(y))))
        for at in range(0, len(x), step):
            i = x[at : at + step]
            p, q = np.nonzero(pairs(i, y) & (component[i][:, None] != component[y][None]))
            one.append(node[i[p]])
            two.append(node[y[q]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (one, two))
        found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = None
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("place")).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            for begin, end in zip(cuts, np.r_[cuts[1:], len(key)], strict=True) if len(key) else ():
                if held and key[begin] != place:
                    yield compare(held)
                    held = []
                place = key[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield compare(held)

    return placed.mapInArrow(trimmed(work), "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, w = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if 100 * min(len(u), len(w)) < similar * max(len(u), len(w)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([u, w]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similar * (len(both) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (whether that is its own), a row per document."""
    return grouped(docs, k, similar).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int, similar: int) -> DataFrame:
    """As near_duplicates(), with a hash of the text, which tells rows of one id apart, and the number of the group (null: none)."""
    signed = stored(signatures(docs, k), "signatures")
    linked = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = linked.groupBy("node", "check").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes.select("node", "check", "first.doc_id", "first.text_hash", "bands"), "sets")
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "doc_id")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", "doc_id").alias("centre")).filter("n > 1")
    shared = stored(shared.select("bucket", "centre"), "buckets")
    members = stored(members.select("bucket", "node").join(shared, "bucket").select("bucket", "node", "centre"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    wanted = stored(wanted, "wanted")
    # a text is told by its id and hash, as one id may have many texts
    own = F.xxhash64("doc_id", "text_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    near = parted(texts, own, bit_map(wanted, own, "wanted-map"))[0]  # few texts are shuffled
    sets = stored(full_sets(near.join(wanted, ["doc_id", "text_hash"]), k, similar).dropDuplicates(["node"]), "shingles")
    links = confirmed(members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), sets, similar)
    found = stored(components(links), "components")
    placed = stored(members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed-members")
    fresh = confirmed(crossing(placed, sets, similar), sets, similar)
    stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # what is linked so far
    found = stored(components(fresh.unionByName(stars)), "components")
    groups = nodes.select("node", "doc_id").join(found, "node").select("component", "node", "doc_id")
    groups = stored(groups, "groups")
    lowest = stored(groups.groupBy("component").agg(F.min("doc_id").alias("component_id")), "lowest")  # so that the join below can split a large group
    placed = nodes.select("node", "check", "doc_id").join(groups.join(lowest, "component").select("node", "component", "component_id"), "node", "left")
    placed = stored(placed.select("node", "check", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id")), "placed")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node", "check").join(placed, ["node", "check"], "left")
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def deduplicated(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` of which exactly one of each group stays: that with the smallest id (null last), then the smallest
    hash of the text; of rows equal in both any one.  Rows without words are in no group and stay."""
    text_hash, key = F.xxhash64("text"), F.col("doc_id").cast("long")
    # rows without an id get one that is larger than all others, by their text
    number = F.coalesce(key, F.xxhash64(F.lit("no id"), "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    rows = grouped(docs.select(number.alias("doc_id"), "text"), k, similar).filter("n_shingles > 0").select("component", "doc_id", "text_hash")
    counts = stored(rows.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "dedup-rows")
    first = stored(counts.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "dedup-first")
    judged = counts.join(first, "component").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    judged = stored(judged.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_number"), F.col("text_hash").alias("_text_hash"), "stays"), "removed")
    near, far = parted(docs, F.xxhash64(number, text_hash), bit_map(judged, F.xxhash64("_number", "_text_hash"), "removed-map"))
    same = (number == F.col("_number")) & (text_hash == F.col("_text_hash"))
    left = far.unionByName(near.join(judged, same, "left_anti").select(*docs.columns))
    repeated = judged.filter("stays")
    if repeated.isEmpty():
        return left
    again = near.join(repeated, same).dropDuplicates(["_number", "_text_hash"]).select(*docs.columns)
    return left.unionByName(again)
