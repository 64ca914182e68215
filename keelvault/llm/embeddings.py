"""Near-duplicate embeddings by a robust-pruned flat graph (operator 8).

Vectors of one label and length are normalised in double precision; equal vectors are one node with a count.  Sampled centres
cut a label of more than CELL nodes into cells.  A node is at home in its nearest centre's cell and a guest in each cell whose
boundary plane is within a reach of it (``guest_cells``); so the shards overlap.  The reach is measured: TUNE sampled nodes are
compared with all nodes of their label, and the farthest that one of their links lies behind a boundary, with half as much
again, is the reach.  With the full distance of a link as reach no link is missed, whatever its direction.

A shard's graph is built in overlapping blocks: each node is put into the blocks of its two nearest centres, a block larger than
BLOCK (a dense group) is cut at random, twice over.  In a block the nearest nodes of each are pruned robustly, so that edges also
lead away; the adjacency lists of all blocks are united, with the reverse of each edge, into one graph of the shard.  A batch of
searches starts at the blocks' medoids (and at the node itself), walks greedily with a beam, and expands every node in range.
Cosines are verified in double precision.

Recall is audited twice.  In each shard some searches are also answered by brute force; where they miss too much the whole shard
is.  Over the corpus AUDIT other sampled nodes are compared with all nodes of their label; a label whose links were not found to
AUDIT_RECALL is searched anew, with the full distance as reach and by brute force in its shards.

Bounds: on the driver samples of at most SAMPLE_VALUES numbers, and a row for each cell of over MEMBERS nodes.  Such a cell (a
dense or hot group) is cut into parts: each part's nodes are searched in each part's graph, in tasks of their own; so no task
holds more than about 2 * MEMBERS nodes.  Links aren't written out: each node's number of links is summed with the counts of the
nodes found, and the links inside a task become a tree (node, smallest node of its part), which the components are made of.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and any vector with a null label,
links with nothing and is its own component; vectors of different lengths don't link; a null vec_id gets a null component; equal
vec_ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import stored
from ._text import mix, trimmed

COSINE = 0.98
#: Nodes of a label in a cell, on average; the most cells in all that have centres; numbers in all sampled vectors.
CELL, MOST_CENTRES, SAMPLE_VALUES = 4096, 8192, 4_000_000
#: Nodes of a shard, beyond which it is cut into parts.
MEMBERS = 16_384
#: Nodes in a block, edges of a node, candidates for them, slack of robust pruning, width of the beam, medoids to start from.
BLOCK, DEGREE, POOL, ALPHA, BEAM, STARTS = 512, 12, 32, 1.2, 6, 3
#: Searches at once, query-node places of these (fewer searches in a large shard), and edges that are followed at once: in a dense
#: group every search reaches every node.
BATCH, PLACES, EDGES = 256, 1 << 21, 1 << 19
#: Nodes by which the reach is measured and the result is audited, and the least recall; searches audited in a shard.
TUNE, AUDIT, AUDIT_RECALL, SHARD_AUDIT = 1024, 1024, 0.999, 24
#: The least reach, in standard deviations of a link that has no preferred direction.
SPREAD = 2.5


def distance_of(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def unit(flat: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow."""
    x = flat.astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def behind(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and how far it is from the boundary plane between home and each other cell (0 at home).

    A point within that distance of x that is nearer to centre c than to x's home h lies beyond their bisecting plane, from which
    x is (|x-c|^2 - |x-h|^2) / (2 |c-h|) away.
    """
    squares = (centres**2).sum(1)
    d2 = 1 + squares - 2 * x @ centres.T
    home = d2.argmin(1)
    apart = np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * centres[home] @ centres.T, 1e-18))
    return home, np.maximum(d2 - d2[np.arange(len(x)), home][:, None], 0) / (2 * apart)


def at_once(k: int) -> int:
    """How many vectors are compared with k centres at once, for matrices of about 16 MB."""
    return max(16, (1 << 21) // max(k, 1))


def guest_cells(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and whether it must be known in each cell (a matrix; true at home)."""
    home, away = behind(x, centres)
    near = away <= reach + 1e-9
    near[np.arange(len(x)), home] = True
    return home, near


def refined(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k centres by a few rounds of k-means on a bounded sample."""
    centres = sample[np.random.default_rng(k).choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        half, step = (centres**2).sum(1) / 2, at_once(len(centres))
        own = np.concatenate([(sample[a : a + step] @ centres.T - half).argmax(1) for a in range(0, len(sample), step)])
        used, which, n = np.unique(own, return_inverse=True, return_counts=True)
        sums = np.zeros((len(used), sample.shape[1]))
        np.add.at(sums, which, sample)
        centres = sums / n[:, None]
    return np.unique(centres, axis=0)


# --- the graph of a shard --------------------------------------------------------------------------------------------------


def pruned(x: np.ndarray, pool: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning of every node's candidates (nearest first) at once: at most DEGREE neighbours each, -1 for none.

    A candidate falls if some neighbour kept before is nearer to it, by the factor ALPHA, than the node itself.
    """
    n, width = pool.shape
    out = np.full((n, DEGREE), -1)
    count, alive = np.zeros(n, np.int64), pool >= 0
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    for j in range(width):
        take = np.flatnonzero(alive[:, j] & (count < DEGREE))
        if not len(take):
            continue
        p = pool[take, j]
        out[take, count[take]] = p
        count[take] += 1
        if j + 1 < width:
            rest = pool[take, j + 1 :]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nkd,nd->nk", x[np.maximum(rest, 0)], x[p]), 0))
            alive[take, j + 1 :] &= ALPHA * between > far[take, j + 1 :]
    return out


def blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    """Overlapping blocks of at most BLOCK nodes: each node is in those of its two nearest centres."""
    n = len(x)
    if n <= BLOCK:
        yield np.arange(n)
        return
    rng = np.random.default_rng(n)
    k = -(-3 * n // BLOCK)
    centres = refined(x[rng.choice(n, min(n, 16 * k), replace=False)], k, 3)
    near = np.empty((n, min(2, len(centres))), np.int64)
    for a in range(0, n, 4096):
        score = x[a : a + 4096] @ centres.T - (centres**2).sum(1) / 2
        near[a : a + 4096] = np.argpartition(-score, near.shape[1] - 1, 1)[:, : near.shape[1]]
    for c in range(len(centres)):
        some = np.flatnonzero((near == c).any(1))
        if len(some) <= BLOCK:
            if len(some):
                yield some
            continue
        for _ in range(2):  # a dense group: cut at random, twice over, so that the cuts overlap
            yield from np.array_split(rng.permutation(some), -(-len(some) // BLOCK))


class Graph:
    """The united adjacency lists of a shard's blocks, and the blocks' medoids."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, n = x, len(x)
        pairs, medoids = [], []
        for some in blocks(x):
            y = x[some]
            medoids.append(some[int((y @ y.mean(0)).argmax())])
            width = min(POOL, len(some) - 1)
            if width < 1:
                continue
            s = y @ y.T
            np.fill_diagonal(s, -2)
            near = np.argpartition(-s, width - 1, 1)[:, :width]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1, kind="stable"), 1)
            kept = pruned(y, near, np.take_along_axis(s, near, 1))
            src, dst = np.nonzero(kept >= 0)[0], kept[kept >= 0]
            pairs.append(some[src] * n + some[dst])
            pairs.append(some[dst] * n + some[src])  # the reverse of each edge, so that every node is reached
        edges = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.to = (edges % n).astype(np.int32) if n else np.zeros(0, np.int32)
        self.begin = np.searchsorted(edges, np.arange(n + 1) * n)
        self.medoids = np.unique(np.array(medoids, np.int64))

    def within(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs found with a cosine of at least COSINE; own: the node that a query is, or -1."""
        n, b = len(self.x), len(queries)
        seen, mark = np.zeros(b * n, bool), np.empty(b * n, np.int32)
        starts = min(STARTS, len(self.medoids))
        first = self.medoids[np.argpartition(-(queries @ self.x[self.medoids].T), starts - 1, 1)[:, :starts]]
        known = np.flatnonzero(own >= 0)
        q, node = np.concatenate([np.repeat(np.arange(b), starts), known]), np.concatenate([first.ravel(), own[known]])
        hits_q, hits = [], []

        def visited(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Those of the places that weren't seen before, each once, and their cosines."""
            code = q * n + node
            code = code[~seen[code]]
            mark[code] = np.arange(len(code), dtype=np.int32)
            code = code[mark[code] == np.arange(len(code))]  # each once
            seen[code] = True
            q, node = code // n, code % n
            sim = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", queries[q[a : a + 16384]], self.x[node[a : a + 16384]]) for a in range(0, len(q), 16384)]])
            return q, node, sim

        def neighbours(q: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The neighbours of the places, about EDGES at once."""
            degree = self.begin[node + 1] - self.begin[node]
            ends = np.cumsum(degree)
            cuts = np.searchsorted(ends, np.arange(EDGES, (ends[-1] if len(ends) else 0) + EDGES, EDGES), "right")
            for a, b in zip(np.r_[0, cuts][:-1], cuts, strict=True):
                some = degree[a:b]
                at = np.repeat(self.begin[node[a:b]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
                yield np.repeat(q[a:b], some), self.to[at].astype(np.int64)

        beam_q, beam, beam_sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        fresh = True
        while len(q):
            found = [visited(*some) for some in ([(q, node)] if fresh else neighbours(q, node))]
            fresh = False
            q, node, sim = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (q[:0], node[:0], np.zeros(0))
            near = sim >= COSINE
            hits_q.append(q[near])
            hits.append(node[near])
            # of the others, each query goes on with the best that its beam holds
            open_ = np.r_[np.zeros(len(beam), bool), np.ones(int((~near).sum()), bool)]
            beam_q, beam, beam_sim = np.r_[beam_q, q[~near]], np.r_[beam, node[~near]], np.r_[beam_sim, sim[~near]]
            by = np.lexsort((-beam_sim, beam_q))
            by = by[np.arange(len(by)) - np.searchsorted(beam_q[by], beam_q[by]) < BEAM]
            beam_q, beam, beam_sim, open_ = beam_q[by], beam[by], beam_sim[by], open_[by]
            q, node = np.r_[q[near], beam_q[open_]], np.r_[node[near], beam[open_]]
        return np.concatenate(hits_q), np.concatenate(hits)


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of the nodes a[i] and b[i]; root[i] is the smallest node of a part, before and after."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def pairs_of_shard(x: np.ndarray, member: np.ndarray, query: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the nodes of a task: the links of queries to members, in batches (query, member), without a node's link to itself.
    A node may be a member, a query or both."""
    inside, asked = np.flatnonzero(member), np.flatnonzero(query)
    if not len(inside) or not len(asked):
        return
    y = x[inside]
    place = np.full(len(x), -1)
    place[inside] = np.arange(len(inside))

    def exhaustive(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(x[some] @ y.T >= COSINE)

    if not exact:
        graph = Graph(y)
        checked = asked[:: max(1, len(asked) // SHARD_AUDIT)]
        truth, found = exhaustive(checked), graph.within(x[checked], place[checked])
        own = place[checked]  # a query's hit on itself says nothing
        there, got = ((v != own[q]).sum() for q, v in (truth, found))
        exact = got < AUDIT_RECALL * there
    step = max(16, min(BATCH, PLACES // len(inside)))
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        q, v = exhaustive(some) if exact else graph.within(x[some], place[some])
        other = inside[v] != some[q]
        yield some[q[other]], inside[v[other]]


def codes(node: np.ndarray) -> np.ndarray:
    """A hash of each node, by which sets of nodes are compared."""
    return mix(node.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


# --- the distribution ------------------------------------------------------------------------------------------------------


class Cells:
    """Broadcast: by group (label and length) the centres and the reach, and by cell the parts it is cut into."""

    def __init__(self, centres: dict[str, np.ndarray], reach: dict[str, float], parts: dict[str, int]) -> None:
        self.centres, self.reach, self.parts = centres, reach, parts


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, rows, unit vectors) of a batch with the columns group and embedding."""
    names = batch.column(batch.schema.get_field_index("group")).to_numpy(zero_copy_only=False)
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    for name in np.unique(names) if len(names) else ():
        rows = np.flatnonzero(names == name)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield str(name), rows, unit(flat.reshape(len(rows), -1))


def spread(cells, what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Work that sends each node to its cells.  what "sizes": (cell, n) only; "nodes": a row for each task that needs the node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            for group, rows, x in by_group(batch):
                centres = own.centres.get(group)
                step = at_once(0 if centres is None else len(centres))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    if centres is None:
                        at, cell, home = np.arange(len(some)), np.zeros(len(some), np.int64), np.ones(len(some), bool)
                    else:
                        first, near = guest_cells(x[a : a + step], centres, own.reach[group])
                        at, cell = np.nonzero(near)
                        home = first[at] == cell
                    if what == "sizes":
                        found, n = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{group}/{c}" for c in found], pa.string()), pa.array(n.astype(np.int64))], names=["cell", "n"])
                        continue
                    row, names = some[at], np.array([f"{group}/{c}" for c in cell], object)
                    parts = np.array([own.parts.get(c, 1) for c in names])
                    node = batch.column(0).to_numpy()[row]
                    part = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)
                    # member in every (i, part), query (if at home) in every (part, j)
                    times = np.where(parts > 1, np.where(home, 2 * parts - 1, parts), 1)
                    which = np.repeat(np.arange(len(row)), times)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    own_part, count = part[which], parts[which]
                    as_member = nth < count
                    i = np.where(as_member, nth, own_part)
                    j = np.where(as_member, own_part, (nth - count) + (nth - count >= own_part))
                    asks = home[which] & (i == own_part)
                    take = pa.array(row[which])
                    columns = [pa.array([f"{c}/{p}/{r}" for c, p, r in zip(names[which], i, j, strict=True)], pa.string()), pa.array(as_member), pa.array(asks), *[batch.column(k).take(take) for k in (0, 1, 4, 3)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "member", "asks", "node", "n", "wanted", "embedding"])

    return work


#: What a task says of its nodes: links found, a node that stands for the part, whether the node asked, and what it found and
#: by whom it was found, as the exclusive or of their codes.
OF_NODES = "node long, n_links long, root long, asks boolean, own long, back long"


def linked(batches: Iterator[pa.RecordBatch], exact: bool, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Tasks' rows, sorted by task, to OF_NODES; pairs: to a, b, n_b of the links with a wanted node a, in both directions."""
    held: list[pa.RecordBatch] = []
    task = None

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        member, asks, node, n = (table[c].to_numpy() for c in ("member", "asks", "node", "n"))
        flat = pa.concat_arrays([b.column(b.schema.get_field_index("embedding")).flatten() for b in held]).to_numpy(zero_copy_only=False)
        found = pairs_of_shard(unit(flat.reshape(len(node), -1)), member, asks, exact)
        if pairs:
            wanted = table["wanted"].to_numpy()
            for q, v in found:  # never all links of a task at once
                to, back = wanted[q], wanted[v]
                a, b = np.r_[q[to], v[back]], np.r_[v[to], q[back]]
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(n[b])], names=["a", "b", "n_b"])
            return
        n_links, part = np.zeros(len(node), np.int64), np.arange(len(node))
        code, own, back = codes(node), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for q, v in found:
            np.add.at(n_links, q, n[v])
            hooked(part, q, v)
            np.bitwise_xor.at(own, q, code[v])
            np.bitwise_xor.at(back, v, code[q])
        low = np.full(len(node), np.iinfo(np.int64).max)  # the smallest node number stands for a part
        np.minimum.at(low, part, node)
        columns = {"node": node, "n_links": n_links, "root": low[part], "asks": asks, "own": own, "back": back}
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, int)
        for begin, end in zip(cuts, np.r_[cuts[1:], len(names)], strict=True) if len(names) else ():
            if held and names[begin] != task:
                yield from done()
                held = []
            task = names[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield from done()


def searched(nodes: DataFrame, cells: Cells, exact: bool, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """OF_NODES of all tasks; wanted (node): the pairs of these nodes instead, of the same search."""
    if wanted is None:
        nodes = nodes.withColumn("wanted", F.lit(False))
    else:
        mine = wanted.select(F.col("node").alias("_node"), F.lit(True).alias("_wanted"))
        nodes = nodes.join(mine, F.col("node") == F.col("_node"), "left").select(*nodes.columns, F.coalesce("_wanted", F.lit(False)).alias("wanted"))
    context = nodes.sparkSession.sparkContext
    shared = context.broadcast(cells)
    sizes = nodes.mapInArrow(trimmed(spread(shared, "sizes")), "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total, wide = sizes.agg(F.sum("n")).first()[0] or 0, sizes.filter(F.col("n") > MEMBERS).collect()  # few: cells of that size
    cut = Cells(cells.centres, cells.reach, {r["cell"]: -(-r["n"] // MEMBERS) for r in wide})
    more = sum(r["n"] * 2 * -(-r["n"] // MEMBERS) for r in wide)
    shared = context.broadcast(cut)
    kind = nodes.schema["embedding"].dataType.simpleString()
    placed = nodes.mapInArrow(trimmed(spread(shared, "nodes")), f"task string, member boolean, asks boolean, node long, n long, wanted boolean, embedding {kind}")
    parts = max(context.defaultParallelism, -(-(total + more) // CELL))
    placed = placed.repartition(min(parts, 50_000), "task").sortWithinPartitions("task", F.desc("n"), "node")
    pairs = wanted is not None  # a task's function must not hold a table
    return stored(placed.mapInArrow(trimmed(lambda batches: linked(batches, exact, pairs)), "a long, b long, n_b long" if pairs else OF_NODES), name)


def exhaustive_cells(nodes: DataFrame, cells: Cells, groups: list[str]) -> Cells:
    """For the exact way: cells with the full distance of a link as reach; where nearly every node would be a guest nearly
    everywhere, a group without cells, whose parts meet in fewer copies of its nodes."""
    full = Cells({g: cells.centres[g] for g in groups}, dict.fromkeys(groups, distance_of(COSINE)), {})
    shared = nodes.sparkSession.sparkContext.broadcast(full)
    sizes = nodes.mapInArrow(trimmed(spread(shared, "sizes")), "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    group = F.regexp_extract("cell", "^(.*)/[0-9]+$", 1)
    sent = F.sum(F.col("n") * F.ceil(F.col("n") / MEMBERS))
    by_cells = {r["group"]: r["sent"] for r in sizes.groupBy(group.alias("group")).agg(sent.alias("sent")).collect()}  # a row a group
    whole = {r["group"]: r["count"] * (2 * -(-r["count"] // MEMBERS) - 1) for r in nodes.groupBy("group").count().collect()}
    cut = {g: c for g, c in full.centres.items() if by_cells.get(g, 0) < whole.get(g, 0)}
    return Cells(cut, {g: full.reach[g] for g in cut}, {})


def near_pairs(nodes: DataFrame, queries: dict[str, tuple[np.ndarray, np.ndarray]], cells: Cells) -> DataFrame:
    """Brute force over all nodes, for a bounded number of queries (by group: node numbers and unit vectors): query, n (the
    counts of the nodes linked with it, without its own), away (how far the farthest of them is behind a boundary)."""
    shared = nodes.sparkSession.sparkContext.broadcast((queries, cells))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for group, rows, x in by_group(batch):
                if group not in asked:
                    continue
                names, y = asked[group]
                home, _ = behind(y, own.centres[group])
                at, q = np.nonzero(x @ y.T >= COSINE)
                other = node[rows[at]] != names[q]
                at, q = at[other], q[other]
                centres = own.centres[group]
                step = at_once(len(centres))
                away = np.concatenate([np.zeros(0), *[behind(x[at[a : a + step]], centres)[1][np.arange(len(at[a : a + step])), home[q[a : a + step]]] for a in range(0, len(at), step)]])
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(n[rows[at]]), pa.array(away)], names=["query", "n", "away"])

    found = nodes.mapInArrow(trimmed(work), "query long, n long, away double")
    return found.groupBy("query").agg(F.sum("n").alias("n"), F.max("away").alias("away"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row per vector."""
    rows = vectors.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    group = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    # nodes: distinct vectors of a label; -0.0 counts as 0.0
    plain = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    key = F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", group, plain.cast("array<string>")), 256))
    keyed = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", group.alias("group"), key.alias("key")), "vectors")
    grouped = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.any_value("group").alias("group"), F.any_value("embedding").alias("embedding"))
    nodes = stored(grouped.select("key", "node", "n", "group", "embedding"), "vector-nodes")
    plain_nodes = nodes.select("node", "n", "group", "embedding")
    cells, audit = tuned(plain_nodes)
    found = searched(plain_nodes, cells, False, "vector-links")
    short = missed(plain_nodes, found, cells, audit)
    if short:  # the exact way for labels whose links weren't all found
        some = F.col("group").isin(short)
        anew = searched(plain_nodes.filter(some), exhaustive_cells(plain_nodes.filter(some), cells, short), True, "vector-links-exact")
        found = found.join(plain_nodes.filter(some).select("node"), "node", "left_anti").unionByName(anew)
    component = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = stored(found.groupBy("node").agg(F.sum(F.when(F.col("asks"), F.col("n_links"))).alias("n_links"), F.bit_xor("own").alias("own"), F.bit_xor("back").alias("back")), "vector-counts")
    # a link that only one end has found counts for both: the ends whose two sets differ are told by their codes
    uneven = links.filter("own <> back")
    if not uneven.isEmpty():
        pairs = searched(plain_nodes if not short else plain_nodes.filter(~some), cells, False, "vector-pairs", uneven)
        right = pairs.distinct().groupBy("a").agg(F.sum("n_b").alias("right"))
        links = links.join(right, F.col("node") == F.col("a"), "left").withColumn("n_links", F.coalesce("right", "n_links"))
    links = links.select("node", "n_links")
    by_node = nodes.select("key", "node", "n").join(links, "node").join(component, "node", "left")
    by_node = stored(by_node.select("key", (F.col("n_links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-components")
    # vectors without a key aren't joined, as all of them would meet in one task
    out = keyed.filter("key IS NOT NULL").select("vec_id", "key").join(by_node, "key").drop("key")
    none = F.lit(None).cast("long")
    out = out.unionByName(keyed.filter("key IS NULL").select("vec_id", none.alias("n_links"), none.alias("component_id")))
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


def tuned(nodes: DataFrame) -> tuple[Cells, dict]:
    """The cells of the labels of more than CELL nodes, with measured reaches, and sampled nodes for the audit."""
    large = nodes.groupBy("group").count().filter(F.col("count") > CELL).orderBy(F.desc("count"), "group").limit(MOST_CENTRES // 2).collect()
    sizes = {r["group"]: r["count"] for r in large}
    if not sizes:
        return Cells({}, {}, {}), {}
    longest = max(int(g.rpartition("/")[2]) for g in sizes)
    most = max(2, min(MOST_CENTRES, SAMPLE_VALUES // (12 * longest)))
    share = min(1.0, most * CELL / sum(sizes.values()))
    wanted = {g: max(2, round(n * share / CELL)) for g, n in sizes.items()}
    each = max(8, (TUNE + AUDIT) // len(sizes))
    rate = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, int(min(1.0, (8 * wanted[g] + each) / n) * 1_000_000) + 1)])
    draw = nodes.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < F.coalesce(rate[F.col("group")], F.lit(0)))
    table = draw.select("node", F.lit(1).cast("long").alias("n"), "group", "embedding").limit(2 * SAMPLE_VALUES // longest).toArrow()
    centres, tune, audit = {}, {}, {}
    for batch in table.combine_chunks().to_batches():
        for g, at, x in by_group(batch):
            names = batch.column(0).to_numpy()[at]
            by = np.argsort(names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # in no order of the data, and the same each time
            names, x = names[by], x[by]
            half = min(each, len(names)) // 2
            tune[g], audit[g] = (names[:half], x[:half]), (names[half : 2 * half], x[half : 2 * half])
            centres[g] = refined(x, wanted[g])
    full = distance_of(COSINE)
    cells = Cells(centres, dict.fromkeys(centres, full), {})
    away: dict[str, float] = {}
    of = {int(q): g for g, (names, _) in tune.items() for q in names}
    for r in near_pairs(nodes, tune, cells).collect():  # a row for each of the TUNE nodes at most
        away[of[r["query"]]] = max(away.get(of[r["query"]], 0.0), r["away"])
    for g in centres:
        cells.reach[g] = min(full, max(SPREAD * full / np.sqrt(int(g.rpartition("/")[2])), 1.5 * away.get(g, 0.0)))
    return cells, audit


def missed(nodes: DataFrame, found: DataFrame, cells: Cells, audit: dict) -> list[str]:
    """The groups whose audited nodes have fewer links found than brute force finds."""
    if not audit:
        return []
    of = {int(q): g for g, (names, _) in audit.items() for q in names}
    got = found.filter("asks").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    truth = near_pairs(nodes, audit, cells)
    both = truth.join(got, truth["query"] == got["node"]).select("query", "n", "n_links").collect()  # a row for each of the AUDIT nodes at most
    there, here = dict.fromkeys(audit, 0), dict.fromkeys(audit, 0)
    for r in both:
        there[of[r["query"]]] += r["n"]
        here[of[r["query"]]] += r["n_links"]
    return sorted(g for g in audit if here[g] < AUDIT_RECALL * there[g])
