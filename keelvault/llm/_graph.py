"""Connected components: by alternating large-star and small-star steps on DataFrames, the last LOCAL_EDGES edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _print(edges: DataFrame) -> tuple:
    """Count and hash of an edge set, to see whether a step changed it."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: A graph of at most so many edges (16 bytes each) is small enough for one task; both ways give the same result.
LOCAL_EDGES = 2_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest reachable node of each node, by hooking and halving paths on arrays."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  Returns node, component (the smallest node reachable) for each node of an edge.

    Neighbourhoods are never gathered: a step aggregates the smallest neighbour and joins it back, so a node with very many
    neighbours is an ordinary skewed join key.  The number of steps grows with the logarithm of the size.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = _print(edges)
    while seen[0] > LOCAL_EDGES:
        both = _both(edges)
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # each larger neighbour to the smallest
        large = stored(large.distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "small-star")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    if seen[0] <= LOCAL_EDGES:
        return edges.coalesce(1).mapInArrow(_local, "node long, component long")
    found = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = edges.select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(roots)
