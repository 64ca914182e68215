"""Hard-negative mining by branch and bound over ball trees (operator 11).

An anchor's positives are the rows of its label with the highest inner products; for each positive, its hard negatives are the
highest-scoring rows of other labels whose score lies in a window below the positive's.  Components are floored to integers
first, so scores are exact and ties are real: they go to the smaller id.

1. Vectors are ordered by length, nearest of a bounded number of sampled centres, label and id (ranges, so that no centre, label
   or id is too much for a task) and cut into shards; each shard's ball tree is built once and written.
2. Anchors are taken in blocks of at most ANCHOR_VALUES numbers, each broadcast once; every block meets every tree.
3. A ball with centre c and radius r bounds the inner products of an anchor q from both sides: q.c - |q|r and q.c + |q|r.  A node
   goes if its label is the wrong one, if its bounds miss the window, or if the upper bound is strictly beneath the kth score
   found so far (which is carried from tree to tree within a task).  What is left at the leaves is scored exactly.
4. Each task returns at most k rows for an anchor (and positive); Spark ranks them.  Positives first, then their windows.

Bounds: a task holds one shard and the best of one block of anchors; the driver one block and its positives.  Nothing is dropped:
the trees only save work.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; only vectors of one
length are compared; rows with the anchor's own id are never found; equal rows (id, label, vector) count once; an anchor without
positives, and a positive whose window is empty, give no rows; windows of negative scores are empty; an empty table gives an
empty result; other columns are ignored.  Scores that don't fit 56 bits are an error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import scratch_path, stored
from ._text import trimmed
from .embeddings import at_once, refined

SCALE, LOW, HIGH, POSITIVES, NEGATIVES = 256, 80, 100, 5, 5
#: Rows of a shard and of a leaf; the most centres, numbers in the sample for them, and numbers in a block of anchors.
SHARD, LEAF, MOST_CELLS, SAMPLE_VALUES, ANCHOR_VALUES = 8192, 64, 1024, 2_000_000, 2_000_000
#: Anchors searched at once in a task; labels of a shard up to which its tree parts labels first.
BATCH, PARTED_LABELS = 2048, 64
#: A gap is wide if it is this share of a node's extent.
GAP = 0.1
NONE, NO_ID = -(1 << 62), np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --- trees -----------------------------------------------------------------------------------------------------------------


def build_tree(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """order of the rows, and for each node: rows [start, end) in that order, children (-1: a leaf), ball, lowest and highest label."""
    x = x.astype(float)
    order = np.argsort(labels, kind="stable")
    parted = len(np.unique(labels)) <= PARTED_LABELS
    start, end, left, right, centre, radius, low, high = [0], [len(x)], [], [], [], [], [], []
    at = 0
    while at < len(start):
        own = order[start[at] : end[at]]
        points, names = x[own], labels[own]
        c = points.mean(0)
        away = np.sqrt(((points - c) ** 2).sum(1))
        centre.append(c)
        radius.append(away.max())
        low.append(names.min())
        high.append(names.max())
        if len(own) <= leaf:
            left.append(-1)
            right.append(-1)
        else:
            if parted and low[-1] < high[-1]:  # rows are in the order of their labels down to here
                cuts = np.flatnonzero(np.diff(names)) + 1
                cut = int(cuts[np.abs(cuts - len(own) // 2).argmin()])
            else:
                a = points[away.argmax()]
                line = points[((points - a) ** 2).sum(1).argmax()] - a
                along = points @ line
                by = np.argsort(along, kind="stable")
                order[start[at] : end[at]] = own[by]
                cut = _cut(along[by])
            left.append(len(start))
            right.append(len(start) + 1)
            start += [start[at], start[at] + cut]
            end += [start[at] + cut, end[at]]
        at += 1
    ints = {"start": start, "end": end, "left": left, "right": right, "low": low, "high": high}
    return {"order": order, "centre": np.array(centre), "radius": np.array(radius)} | {k: np.array(v, np.int64) for k, v in ints.items()}


def _cut(along: np.ndarray) -> int:
    """Where sorted values part: at a wide gap that leaves a thirty-second on each side, else in the middle."""
    n = len(along)
    edge = max(1, n // 32)
    gaps = np.diff(along)[edge - 1 : n - edge]
    best = int(gaps.argmax())
    return best + edge if gaps[best] > GAP * (along[-1] - along[0]) else n // 2


def packed(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, leaf: int) -> bytes:
    """A shard with its tree, rows in the tree's order."""
    tree = build_tree(q, labels, leaf)
    order, out = tree.pop("order"), io.BytesIO()
    small = q.size == 0 or np.abs(q).max() < 1 << 31
    np.savez(out, ids=ids[order], labels=labels[order], q=q[order].astype(np.int32 if small else np.int64), **tree)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(scale * values.astype(float))
    if x.size and np.abs(x).max() >= 1 << 56:
        raise ValueError("scores don't fit 56 bits")
    return x.astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (float(np.abs(a).max()) * float(np.abs(b).max()) if a.size and b.size else 0.0) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2.0**56:
        raise ValueError("scores don't fit 56 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Search:
    """The k best rows of each slot of some anchors, over any number of trees.

    wide: slots an anchor; lows, highs: their windows (None: none).  same: rows of the anchor's label, else of other labels.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, k: int, wide: int = 1, lows: np.ndarray | None = None, highs: np.ndarray | None = None) -> None:
        self.ids, self.labels, self.q, self.same, self.k = ids, labels, q, same, k
        self.size = np.sqrt((q.astype(float) ** 2).sum(1))
        self.scores, self.found = np.full((len(ids), wide, k), NONE), np.full((len(ids), wide, k), NO_ID)
        self.lows = np.full((len(ids), wide), NONE) if lows is None else lows
        self.highs = np.full((len(ids), wide), -NONE) if highs is None else highs
        self.leaves = 0

    def visit(self, tree: dict[str, np.ndarray]) -> None:
        for a in range(0, len(self.ids), BATCH):
            self._batch(tree, np.arange(a, min(a + BATCH, len(self.ids))))

    def _batch(self, tree: dict[str, np.ndarray], own: np.ndarray) -> None:
        near = self.q[own].astype(float) @ tree["centre"].T
        reach = self.size[own][:, None] * tree["radius"]
        slack = 1e-9 * (self.size[own][:, None] * np.sqrt((tree["centre"] ** 2).sum(1)) + reach) + 1e-6
        above, below = near + reach + slack, near - reach - slack
        pure, low, high = tree["low"] == tree["high"], tree["low"], tree["high"]
        seeds = np.full(len(own), -1)
        if self.same:  # each anchor sees its nearest leaf first, so that its kth score is good
            leaves = np.flatnonzero(tree["left"] < 0)
            fits = (low[leaves] <= self.labels[own][:, None]) & (self.labels[own][:, None] <= high[leaves])
            seeds = leaves[np.where(fits, near[:, leaves], -np.inf).argmax(1)]
            for leaf in np.unique(seeds):
                self._leaf(tree, leaf, own[seeds == leaf])
        stack = [(0, np.arange(len(own)))]
        while stack:
            node, act = stack.pop()
            name = self.labels[own[act]]
            act = act[(low[node] <= name) & (name <= high[node])] if self.same else act[~pure[node] | (low[node] != name)]
            least = np.maximum(self.lows[own[act]], self.scores[own[act], :, -1])
            act = act[((above[act, node][:, None] >= least) & (below[act, node][:, None] <= self.highs[own[act]])).any(1)]
            if not len(act):
                continue
            if tree["left"][node] < 0:
                self._leaf(tree, node, own[act[seeds[act] != node]])
                continue
            a, b = tree["left"][node], tree["right"][node]
            a, b = (a, b) if near[act, a].sum() < near[act, b].sum() else (b, a)
            stack += [(a, act), (b, act)]  # the nearer one is seen first

    def _leaf(self, tree: dict[str, np.ndarray], node: int, act: np.ndarray) -> None:
        if not len(act):
            return
        self.leaves += len(act)
        rows = slice(tree["start"][node], tree["end"][node])
        scores, ids = dots(self.q[act], tree["q"][rows]), tree["ids"][rows]
        fits = (tree["labels"][rows] == self.labels[act][:, None]) == self.same
        fits &= ids != self.ids[act][:, None]
        for w in range(self.scores.shape[1]):
            kth, last = self.scores[act, w, -1][:, None], self.found[act, w, -1][:, None]
            good = fits & (scores >= self.lows[act, w][:, None]) & (scores <= self.highs[act, w][:, None]) & ((scores > kth) | ((scores == kth) & (ids < last)))
            some = np.flatnonzero(good.any(1))
            if not len(some):
                continue
            s = np.concatenate([self.scores[act[some], w], np.where(good[some], scores[some], NONE)], 1)
            i = np.concatenate([self.found[act[some], w], np.where(good[some], ids, NO_ID)], 1)
            first = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.scores[act[some], w], self.found[act[some], w] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


# --- Spark -----------------------------------------------------------------------------------------------------------------


def taking_part(vectors: DataFrame, label: Column | str = "label") -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _matrix(column: pa.Array, rows: slice, width: int) -> np.ndarray:
    part = column.slice(rows.start, rows.stop - rows.start)
    return np.asarray(part.flatten(), float).reshape(rows.stop - rows.start, width)


def with_cells(rows: DataFrame, shard: int) -> DataFrame:
    """With cell: the nearest of the sampled centres of the commonest length; -1 for other lengths."""
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = rows.schema["embedding"].dataType.simpleString()
    if top is None or top["count"] <= shard or not top["d"]:
        return rows.withColumn("cell", F.lit(-1))
    width, n = top["d"], top["count"]
    most = max(1, SAMPLE_VALUES // width)
    own = rows.filter(F.size("embedding") == width).select("vec_id", "embedding")
    sampled = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // most))) == 0).select("embedding").limit(most).toArrow().column(0).combine_chunks()
    if not len(sampled):
        return rows.withColumn("cell", F.lit(-1))
    centres = refined(_matrix(sampled, slice(0, len(sampled)), width), min(MOST_CELLS, -(-n // shard)))

    @trimmed
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, step = (centres**2).sum(1) / 2, at_once(len(centres))
        for batch in batches:
            column = batch.column(2)
            cell = np.full(batch.num_rows, -1, np.int32)
            fit = np.flatnonzero(np.asarray(pc.list_value_length(column)) == width)
            for a in range(0, len(fit), step):
                some = column.take(pa.array(fit[a : a + step]))
                cell[fit[a : a + step]] = (_matrix(some, slice(0, len(some)), width) @ centres.T - half).argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(cells, f"vec_id long, label long, embedding {kind}, cell int")


def trees_of(rows: DataFrame, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """A row a shard: the length of its vectors, and the shard with its tree."""
    keys = [F.size("embedding"), F.col("cell"), F.col("label"), F.col("vec_id"), F.xxhash64("embedding")]
    rows = with_cells(rows, shard)
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("vec_id", "label", "embedding")

    @trimmed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        before = None

        def tree() -> pa.RecordBatch:
            ids, labels, q = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.record_batch([pa.array([q.shape[1]], pa.int32()), pa.array([packed(ids, labels, q, leaf)], pa.binary())], ["width", "tree"])

        for batch in batches:
            width = np.asarray(pc.list_value_length(batch.column(2)))
            edges = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                ids, labels = (np.asarray(batch.column(j))[a:b] for j in (0, 1))
                values = _matrix(batch.column(2), slice(a, b), int(width[a]))
                # equal rows stand next to each other
                new = np.ones(b - a, bool)
                new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (values[1:] != values[:-1]).any(1)
                if before is not None and before[0] == ids[0] and before[1] == labels[0] and np.array_equal(before[2], values[0]):
                    new[0] = False
                before = (ids[-1], labels[-1], values[-1].copy())
                ids, labels, q = ids[new], labels[new], floored(values[new], scale)
                if held and held[0][2].shape[1] != q.shape[1]:
                    yield tree()
                while len(ids):
                    room = shard - sum(len(h[0]) for h in held)
                    held.append((ids[:room], labels[:room], q[:room]))
                    ids, labels, q = ids[room:], labels[room:], q[room:]
                    if sum(len(h[0]) for h in held) == shard:
                        yield tree()
        if held:
            yield tree()

    return rows.mapInArrow(build, "width int, tree binary")


def _searched(trees: DataFrame, block: object, make: Callable[[tuple], Search]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, Search]]]:
    """For a task: the searches of a broadcast block, by length of vector, after all trees of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Search]]:
        searches = {width: make(part) for width, part in block.value.items()}
        for batch in batches:
            for width, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if width in searches:
                    searches[width].visit(unpacked(blob.as_py()))
        yield from searches.items()

    return run


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k by score and id, with their rank: Spark limits each key before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("found").asc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(rows: pa.Table, scale: int) -> dict[int, tuple]:
    """By length of vector: (numbers, ids, labels, integer vectors) of a block of anchors."""
    column = rows.column("embedding").combine_chunks()
    width, ids, labels = np.asarray(pc.list_value_length(column)), np.asarray(rows.column("vec_id")), np.asarray(rows.column("label"))
    out = {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        part = column.take(pa.array(own))
        out[w] = (own, ids[own], labels[own], floored(_matrix(part, slice(0, len(own)), w), scale))
    return out


def positives(trees: DataFrame, block: object, k: int) -> DataFrame:
    """number (of an anchor in the block), score, found, rank: the first k rows of the anchor's label."""
    run = _searched(trees, block, lambda part: Search(*part[1:], True, k))

    @trimmed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, s in run(batches):
            at, _, place = np.nonzero(s.found < NO_ID)
            numbers = block.value[width][0]
            yield pa.record_batch([pa.array(numbers[at]), pa.array(s.scores[at, 0, place]), pa.array(s.found[at, 0, place])], ["number", "score", "found"])

    return _first(trees.mapInArrow(search, "number long, score long, found long"), ["number"], k)


def negatives(trees: DataFrame, block: object, k: int) -> DataFrame:
    """number, slot, anchor_id, positive_id, positive_score, score, found, rank: the first k rows of other labels in each window.

    block: by length: (numbers, ids, labels, vectors, positives' ids, positives' scores, lows, highs).
    """
    run = _searched(trees, block, lambda part: Search(*part[1:4], False, k, part[4].shape[1], part[6], part[7]))
    names = ["number", "slot", "anchor_id", "positive_id", "positive_score", "score", "found"]

    @trimmed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, s in run(batches):
            numbers, ids, _, _, positive, best, _, _ = block.value[width]
            at, slot, place = np.nonzero(s.found < NO_ID)
            columns = [numbers[at], slot, ids[at], positive[at, slot], best[at, slot], s.scores[at, slot, place], s.found[at, slot, place]]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names)

    return _first(trees.mapInArrow(search, ", ".join(f"{n} long" for n in names)), ["number", "slot"], k)


def _with_windows(block: dict[int, tuple], found: pa.Table, k: int, low: int, high: int) -> dict[int, tuple]:
    """The block with each anchor's positives and the windows below them."""
    n = max((int(part[0].max()) + 1 for part in block.values()), default=0)
    ids, scores = np.full((n, k), NO_ID), np.full((n, k), NONE)
    number, place = np.asarray(found.column("number")), np.asarray(found.column("rank")) - 1
    ids[number, place], scores[number, place] = np.asarray(found.column("found")), np.asarray(found.column("score"))
    there = ids < NO_ID
    safe = np.where(there, scores, 0)
    lows, highs = np.where(there, -(-low * safe // 100), 1), np.where(there, high * safe // 100, 0)
    return {w: (*part, ids[part[0]], scores[part[0]], lows[part[0]], highs[part[0]]) for w, part in block.items()}


def mine(vectors: DataFrame, anchor: Column | None = None, label: Column | str = "label", *, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF, anchor_values: int = ANCHOR_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding and what ``label`` needs.  anchor: which rows are anchors (over vec_id, label, embedding; all
    by default).  A window holds the scores s with low * positive <= 100 * s <= high * positive.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, label)
    trees = stored(trees_of(rows, scale, shard, leaf), "negatives-trees")
    anchors = rows.filter(anchor) if anchor is not None else rows
    anchors = anchors.dropDuplicates(["vec_id", "label", "embedding"])
    total = rows.filter(anchor).agg(F.sum(F.size("embedding"))).first()[0] if anchor is not None else rows.agg(F.sum(F.size("embedding"))).first()[0]
    blocks = max(1, -(-(total or 0) // anchor_values))
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")), "negatives-anchors", ["block"])
    path = scratch_path(spark, "negatives-found")
    columns = ["anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    empty = spark.createDataFrame([], RESULT)
    empty.write.parquet(f"{path}/block=none")
    for b in range(blocks):
        own = _block(anchors.filter(F.col("block") == b).select("vec_id", "label", "embedding").toArrow(), scale)
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)
        found = positives(trees, sent, n_positives).select("number", "score", "found", "rank").toArrow()
        windows = spark.sparkContext.broadcast(_with_windows(own, found, n_positives, low, high))
        negatives(trees, windows, n_negatives).select(*columns).write.mode("overwrite").parquet(f"{path}/block={b}")
        sent.unpersist()
        windows.unpersist()
    return spark.read.schema(RESULT).parquet(path).select(*empty.columns)
