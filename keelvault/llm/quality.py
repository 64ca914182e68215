"""Quality by a byte-level convolutional network in numpy (operator 2).

Learned filters of WIDTH bytes slide over the whole text, byte by byte.  Their highest responses in each chunk of two hops
(chunks overlap by one) pass a rectifier; the mean and the highest over all chunks, and the scale of the text's size, go through
one hidden layer into one probability.  A filter is a table of one weight for each byte value and place, so a response is a sum
of lookups.

The network is fitted on the driver by gradient descent (Adam), on a documented bound of rows: at most TRAIN_ROWS labelled
documents outside the held-out fold, in the order of a hash of the id, as many of them as have TRAIN_BYTES together; a text is
taken whole or not at all.  Fitting and scoring cover every byte of a text, slice by slice, in bounded memory.

Defined results: a text shorter than WIDTH bytes is filled up with zero bytes; null and empty texts have no response and all get
the same score; a null label isn't learnt from; of several labels of an id the lowest counts, of several texts that with the
smallest hash; without labels of both classes every score is 0.5; repeated rows score alike; extra columns are carried, and where
one has the score's name already the score takes a longer one (``free_name``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import free_name, stored
from ._text import text_slices
from .toxicity import held_out

WIDTH, FILTERS, HIDDEN = 8, 16, 16
#: Bytes in a hop; a chunk is two hops.
HOP = 256
#: The most rows, and bytes of all their texts, that the network is fitted on.
TRAIN_ROWS, TRAIN_BYTES = 2400, 8 << 20
#: A text larger than this is passed over, so that it doesn't take the place of many.
TRAIN_TEXT = TRAIN_BYTES // 16
EPOCHS, BATCH, RATE = 8, 48, 0.01
#: Bytes from which on the size of a text says no more.
LARGE = 3000
SLICE = 1 << 18


def responses(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Filter responses at the given places."""
    out = table[0, data[at]]
    for k in range(1, WIDTH):
        out = out + table[k, data[at + k]]
    return out


def filled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of less than WIDTH bytes, but for empty ones, with zero bytes after them."""
    n = np.diff(off)
    lack = np.where((n > 0) & (n < WIDTH), WIDTH - n, 0)
    if not lack.any():
        return data, off
    return np.insert(data, np.repeat(off[1:], lack), 0), off + np.concatenate([[0], np.cumsum(lack)])


def hops_of(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each hop, the end of its places, its document, and the hops of each document."""
    n = np.maximum(np.diff(off) - WIDTH + 1, 0)
    hops = -(-n // HOP)
    owner = np.repeat(np.arange(len(n)), hops)
    local = np.arange(int(hops.sum())) - np.repeat(np.cumsum(hops) - hops, hops)
    first = off[:-1][owner] + HOP * local
    return first, np.minimum(first + HOP, (off[:-1] + n)[owner]), owner, hops


def highest(table: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The highest response of each hop and filter, and (where) the place of it; as many hops at a time as SLICE holds."""
    top, place = np.zeros((len(first), FILTERS), np.float32), np.zeros((len(first), FILTERS) if where else 0, np.int64)
    for a in range(0, len(first), SLICE // HOP):
        size = end[a : a + SLICE // HOP] - first[a : a + SLICE // HOP]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first[a : a + SLICE // HOP] - begin, size)
        act = responses(table, data, at)
        high = np.maximum.reduceat(act, begin)
        top[a : a + SLICE // HOP] = high
        if where:
            row, col = np.nonzero(act == np.repeat(high, size, 0))
            place[a + np.repeat(np.arange(len(size)), size)[row], col] = at[row]
    return top, place


def size_of(off: np.ndarray) -> np.ndarray:
    """The scale of a text's size, for which few chunks are judged less strictly; constant from LARGE bytes on."""
    return np.log1p(np.minimum(np.diff(off), LARGE)) / 4


def pooled(table: np.ndarray, bias: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean and highest of the chunks' rectified highest responses, a row per document."""
    out = np.zeros((len(off) - 1, 2 * FILTERS + 1), np.float32)
    out[:, -1] = size_of(off)
    data, off = filled(data, off)
    first, end, owner, hops = hops_of(off)
    if not len(first):
        return out
    top = highest(table, data, first, end)[0]
    # a chunk is a hop and the one after it; a document's last hop counts alone only if it is the sole one
    pair = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top[:0]
    whole = owner[:-1] == owner[1:]
    alone = hops[owner] == 1
    value = np.concatenate([pair[whole], top[alone]])
    who = np.concatenate([owner[:-1][whole], owner[alone]])
    by = np.argsort(who, kind="stable")
    value, who = np.maximum(value[by] + bias, 0), who[by]
    begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    full = who[begin]
    out[full, :FILTERS] = np.add.reduceat(value, begin) / np.diff(np.r_[begin, len(who)])[:, None]
    out[full, FILTERS:-1] = np.maximum.reduceat(value, begin)
    return out


def head(net: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(x @ net["w1"] + net["b1"], 0)
    return 1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> dict:
    """The network, by Adam on mini-batches; the gradient of a maximum goes to the place that reached it."""
    rng = np.random.default_rng(seed)
    net = {
        "table": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, 0.3, (2 * FILTERS + 1, HIDDEN)).astype(np.float32),
        "b1": np.full(HIDDEN, 0.1, np.float32),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "b2": np.float32(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
            grads = gradients(net, data, off, labels[some])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def gradients(net: dict, data: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict:
    n, x = len(off) - 1, np.zeros((len(off) - 1, 2 * FILTERS + 1), np.float32)
    x[:, -1] = size_of(off)
    data, off = filled(data, off)
    first, end, owner, hops = hops_of(off)
    if len(first):
        top, where = highest(net["table"], data, first, end, True)
        nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
        has_next = owner[nxt] == owner
        has_next[-1] = False
        own = has_next | (hops[owner] == 1)
        later = has_next[:, None] & (top[nxt] > top)
        value, place = np.where(later, top[nxt], top)[own], np.where(later, where[nxt], where)[own]
        who = owner[own]
        z = value + net["bias"]
        r = np.maximum(z, 0)
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        full, count = who[begin], np.diff(np.r_[begin, len(who)])
        x[full, :FILTERS] = np.add.reduceat(r, begin) / count[:, None]
        x[full, FILTERS:-1] = np.maximum.reduceat(r, begin)
    h = x @ net["w1"] + net["b1"]
    a = np.maximum(h, 0)
    p = 1 / (1 + np.exp(-np.clip(a @ net["w2"] + net["b2"], -30, 30)))
    d = ((p - y) / n).astype(np.float32)
    grads = {"w2": a.T @ d, "b2": d.sum()}
    dh = np.outer(d, net["w2"]) * (h > 0)
    grads |= {"w1": x.T @ dh, "b1": dh.sum(0), "table": np.zeros_like(net["table"]), "bias": np.zeros(FILTERS, np.float32)}
    if len(first):
        dx = dh @ net["w1"].T
        of = np.repeat(np.arange(len(full)), count)
        best = r == np.maximum.reduceat(r, begin)[of]
        best = best / np.add.reduceat(best.astype(np.float32), begin)[of]  # chunks overlap, so that one place may be the highest of two
        dr = dx[who][:, :FILTERS] / count[of][:, None] + best * dx[who][:, FILTERS:-1]
        dz = dr * (z > 0)
        grads["bias"] = dz.sum(0)
        size = 256 * FILTERS
        column = np.broadcast_to(np.arange(FILTERS), place.shape)
        for k in range(WIDTH):
            index = data[place + k].astype(np.int64) * FILTERS + column
            grads["table"][k] = np.bincount(index.ravel(), dz.ravel(), size).reshape(256, FILTERS)
    return grads


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The network, or None if the training rows lack a class."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = stored(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "quality-fit")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS small rows
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("t"))
    sizes = sizes.filter(F.col("t.n") <= TRAIN_TEXT)
    up_to = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of at most TRAIN_ROWS rows
    fitting = sizes.select("doc_id", "t.h", F.sum("t.n").over(up_to).alias("up_to")).filter(F.col("up_to") <= TRAIN_BYTES).select("doc_id", "h")
    taken = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(stored(fitting, "quality-rows")), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label").toPandas()
    taken = taken.sort_values("doc_id")
    if taken["label"].nunique() < 2:
        return None
    return fit([t.encode() for t in taken["text"]], taken["label"].to_numpy(float))


def score(docs: DataFrame, net: dict | None, column: str = "quality") -> DataFrame:
    """All columns of ``docs`` and the score, a double from 0 to 1, as ``column`` (see free_name)."""
    own, column = docs.columns, free_name(docs, column)
    if net is None:
        return docs.select(*own, F.lit(0.5).alias(column))
    at = own.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            p = [head(net, pooled(net["table"], net["bias"], d, o)) for _, _, d, o in text_slices(batch.column(at), SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *p]).astype(float))], names=[*own, column])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.mapInArrow(work, f"{fields}, `{column}` double")
