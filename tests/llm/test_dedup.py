"""MinHash, substring and embedding dedup against brute force, and the components they share."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelvault.llm import _graph, embeddings, minhash, substring
from keelvault.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def variants(seed=1, groups=6, size=14):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([3, 5, 30, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
            rows.append((len(rows) * 3, " ".join(w).replace("g", "G") if r.random() < 0.3 else "  ".join(w)))
    return rows


def test_minhash(make_docs, odd_rows):
    rows = [*variants(), *((1000 + i, t, "s") for i, (_, t, *_) in enumerate(odd_rows))]
    k = 4
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(make_docs(rows), k=k).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = minhash.deduplicated(make_docs(rows), k=k)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i) and kept.columns == make_docs(rows).columns


def test_minhash_odd_rows(make_docs, odd_rows):
    found = minhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in found}
    assert by[None] == (None, True) and by[8] == (7, False) and by[1] == (1, True)
    assert minhash.near_duplicates(make_docs(odd_rows).limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(make_docs):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, "another text that is not like the others at all")]
    assert sorted((r["doc_id"], r["text"][:7]) for r in minhash.deduplicated(make_docs(rows)).collect()) == [(1, "w0 w1 w"), (2, "another")]


def test_links_that_miss_the_centre_are_found(make_docs):
    """A chain: each text is linked with the next, most not with the smallest id."""
    r = random.Random(9)
    words = [f"w{r.randrange(10_000)}" for _ in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for j in range(3):
            words[(i * 3 + j) * 5 % 200] = f"n{i}{j}"
    found = minhash.near_duplicates(make_docs(rows), k=2).collect()
    assert {r["component_id"] for r in found} == {0}


def test_the_gate_loses_no_small_set():
    """Pairs at the threshold exactly, and just above it; most pairs far below it are left out."""
    r = np.random.default_rng(3)
    for common, more in ((4, 1), (8, 2), (20, 5), (80, 20), (800, 200)):
        for trial in range(40):
            v = r.integers(0, 2**63, 3 * common + 3 * more, dtype=np.uint64)
            one, two, far = v[: common + more // 2], np.r_[v[:common], v[common + more // 2 : common + more]], v[common + more :]
            sets = [np.sort(x) for x in (one, two, far)]
            begin = np.concatenate([[0], np.cumsum(list(map(len, sets)))])
            pairs = minhash.passing(np.diff(begin), minhash.gates(np.concatenate(sets), begin, 80), 80)
            got = pairs(np.arange(3), np.arange(3))
            assert got[0, 1] and got[1, 0] and got[0, 0] and not got[0, 2]


def test_small_texts_that_miss_their_centre(make_docs):
    """Chains of texts of 4 to 12 words whose neighbours are just similar enough."""
    r, rows = random.Random(11), []
    for n in range(4, 13):
        for _ in range(12):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            for _ in range(5):
                rows.append((len(rows), " ".join(words)))
                words = [*words[1:], f"w{r.randrange(10**6)}"] if r.random() < 0.5 and n > 8 else [*words, f"w{r.randrange(10**6)}"]
    sets = {i: shingles(t, 1) for i, t in rows}
    links = [(a, b) for a in sets for b in range(a + 1, min(a + 12, len(rows))) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows), k=1).collect()} == want


@pytest.mark.parametrize("block", [1024, 8])
def test_large_buckets_are_cut(make_docs, monkeypatch, block):
    """Families whose texts share buckets but aren't all linked: every pair of different components is compared."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, rows = random.Random(12), []
    base = [f"w{i}" for i in range(60)]
    for i in range(160):
        words = list(base)
        for _ in range(r.choice([1, 1, 6, 7, 8])):
            words[r.randrange(60)] = f"n{r.randrange(25)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 1) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows), k=1).collect()} == want


def test_one_row_of_each_group_stays(make_docs):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(5, words), (5, words), (5, words + " x"), (None, words), (None, words), (7, words), (None, "alone without an id"), (None, "alone without an id"), (9, ""), (9, ""), (None, None)]
    kept = minhash.deduplicated(make_docs(rows)).collect()
    assert len([r for r in kept if (r["text"] or "").startswith(words)]) == 1 and {r["doc_id"] for r in kept if (r["text"] or "").startswith(words)} == {5}
    assert sorted(str(r["text"]) for r in kept if not (r["text"] or "").startswith("w")) == ["", "", "None", "alone without an id"]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(_graph, "LOCAL_EDGES", limit)
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(130)] + [(i, i + 1) for i in range(200, 215)]
    want = closed({x for e in edges for x in e if e[0] != e[1]}, edges)
    assert {x["node"]: x["component"] for x in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_fm_index():
    r = np.random.default_rng(3)
    text = r.integers(1, 4, 400).astype(np.uint64) * np.uint64(1000)
    text[[99, 250, 251, 399]] = 0
    weights = np.where(np.arange(400) < 100, 2, 1)
    index = FMIndex(text, weights)
    assert not hasattr(index, "text") and not hasattr(index, "order")
    stream = np.concatenate([text[:100], r.integers(1, 6, 300).astype(np.uint64) * np.uint64(1000)])
    stream[99] = 1000
    ends = np.arange(400)
    most = np.minimum(ends + 1, 12)
    length, low, high = index.matching(index.coded(stream), ends, most)

    def places(sequence):
        n = len(sequence)
        return [p for p in range(400 - n + 1) if (text[p : p + n] == sequence).all()]

    for e in ends:
        want = max([n for n in range(1, most[e] + 1) if sum(weights[p] for p in places(stream[e - n + 1 : e + 1])) >= 2], default=0)
        assert length[e] == want
        if want:
            assert sorted(index.locate(np.arange(low[e], high[e])).tolist()) == places(stream[e - want + 1 : e + 1])


def brute_substring(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone[s : s + n] = [True] * n
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


def passages():
    r = random.Random(6)
    common = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.choice([5, 19, 20, 60])))) for i in range(30)]
    for i in range(30, 90):
        w = [f"u{r.randrange(5000)}" for _ in range(r.randrange(80))]
        at = r.randrange(len(w) + 1)
        rows.append((i, "\n".join([*w[:at], *common[r.randrange(5) : r.randrange(20, 41)], *w[at:]])))
    return [*rows, *((200 + i, rows[i][1]) for i in range(25, 60)), (300, "x " * 300), (301, "x " * 100 + "é y")]


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring(make_docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "FILTER_BITS", 12 if hot == 2 else 26)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.deduplicated(make_docs(passages()).repartition(5)).collect()}
    assert found == brute_substring(passages())


def test_substring_odd_rows(make_docs, odd_rows):
    found = substring.deduplicated(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows) and {r["doc_id"]: r["n_words"] for r in found}[1] == 0
    assert substring.deduplicated(make_docs(odd_rows).limit(0)).count() == 0
    repeated = make_docs([(1, " ".join(f"w{i}" for i in range(30)))] * 3)
    assert [r["n_removed"] for r in substring.deduplicated(repeated).collect()] == [0, 0, 0]
    assert hashlib.sha256(b"").hexdigest()  # what an empty kept text gives


def vectors():
    r = np.random.default_rng(12)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = r.normal(size=16)
            for _ in range(r.integers(1, 20)):
                rows.append((len(rows), [float(x) for x in np.float32(centre + r.normal(size=16) * r.choice([0.0, 0.05, 0.1]))], label))
    rows += [(len(rows) + i, v, 0) for i, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0] * 3])]
    return [*rows, (5000, rows[0][1], 0), (5000, rows[0][1], 0), (5001, [x * 4 for x in rows[0][1]], 0), (None, rows[0][1], 0)]


def plain_links(rows):
    """The number of links of each row, and the smallest id that each reaches."""
    degree, links, unit = [], [], []
    for i, v, label in rows:
        v = np.array([np.nan if x is None else x for x in v], float) if v and label is not None and i is not None else np.zeros(0)
        unit.append(v / np.linalg.norm(v) if len(v) and np.isfinite(v).all() and v.any() else None)
    for p, u in enumerate(unit):
        near = [q for q, w in enumerate(unit) if q != p and u is not None and w is not None and len(u) == len(w) and rows[p][2] == rows[q][2] and u @ w >= 0.98]
        degree.append(len(near))
        links += [(rows[p][0], rows[q][0]) for q in near]
    return degree, closed({i for i, *_ in rows if i is not None}, links)


@pytest.mark.parametrize("cell", [4096, 32])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rows = vectors()
    rows += [(7000 + i, [1.0, float(i % 2), 0.1], 0) for i in range(4)]  # a rarer length
    degree, want = plain_links(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, n int")
    found = embeddings.near_duplicates(df).collect()
    assert len(found) == len(rows)
    truth = sorted((str(i), n, str(want.get(i))) for (i, *_), n in zip(rows, degree, strict=True))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == truth
    assert {r["n_links"] for r in found if (r["vec_id"] or 0) >= 7000} == {1}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def links_found(spark, x, label=1):
    df = spark.createDataFrame([(i, v.tolist(), label) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    return np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in embeddings.near_duplicates(df).collect())])


def test_embeddings_links_across_boundaries_of_any_direction(spark, monkeypatch):
    """Vectors on a circle in 64 dimensions: every link that crosses a boundary does so along its normal."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    angle = np.random.default_rng(5).uniform(0, 2 * np.pi, 400)
    flat = np.zeros((400, 64))
    flat[:, 0], flat[:, 1] = np.cos(angle), np.sin(angle)
    assert links_found(spark, flat).tolist() == ((flat @ flat.T >= embeddings.COSINE).sum(1) - 1).tolist()


def test_embeddings_of_few_effective_dimensions(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 300)
    r = np.random.default_rng(6)
    x = r.normal(size=(2500, 4)) @ r.normal(size=(4, 128)) + 0.01 * r.normal(size=(2500, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= embeddings.COSINE).sum(1) - 1
    found = links_found(spark, x)
    assert (found <= truth).all() and found.sum() >= 0.998 * truth.sum()


def test_embeddings_of_a_dense_group(spark, monkeypatch):
    """More distinct vectors within a link of each other than a task may hold."""
    monkeypatch.setattr(embeddings, "CELL", 128)
    monkeypatch.setattr(embeddings, "MEMBERS", 256)
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=24) + 0.02 * r.normal(size=(900, 24)), r.normal(size=(300, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert links_found(spark, x).tolist() == ((x @ x.T >= embeddings.COSINE).sum(1) - 1).tolist()


def test_embedding_graph(monkeypatch):
    """Blocks are bounded whatever the density, and their united lists lead from the medoids to all nodes in range."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    r = np.random.default_rng(8)
    x = np.concatenate([c + s * r.normal(size=(n, 16)) for c, s, n in zip(r.normal(size=(40, 16)), [0.03, 0.1] * 20, r.integers(1, 400, 40), strict=True)])
    x = embeddings.unit(x)
    assert max(map(len, embeddings.blocks(x))) <= 64 and set(np.concatenate(list(embeddings.blocks(x))).tolist()) == set(range(len(x)))
    graph, some = embeddings.Graph(x), np.arange(0, len(x), 7)
    truth = x[some] @ x.T >= embeddings.COSINE
    for own, least in ((some, 0.99), (np.full(len(some), -1), 0.9)):  # as nodes of the graph, and as strangers to it
        q, v = graph.within(x[some], own)
        assert len(set(zip(q.tolist(), v.tolist(), strict=True))) == len(q) and truth[q, v].all()
        assert len(q) >= least * truth.sum()


@pytest.mark.parametrize("members", [16_384, 64])
def test_a_link_counts_for_both_ends(spark, monkeypatch, members):
    """A search that misses links in one direction: what either end finds counts for both."""
    monkeypatch.setattr(embeddings, "CELL", 60)
    monkeypatch.setattr(embeddings, "MEMBERS", members)
    monkeypatch.setattr(embeddings, "missed", lambda *a: [])  # no label is searched anew
    rng = np.random.default_rng(6)
    x = embeddings.unit(rng.normal(size=(400, 3)))
    near = x @ x.T >= embeddings.COSINE
    np.fill_diagonal(near, False)
    lost = np.triu(rng.random(near.shape) < 0.3)  # these are found from the other end only
    rows = {tuple(v): i for i, v in enumerate(x.astype(np.float32).tolist())}
    found = embeddings.pairs_of_shard

    def forgetful(y, member, query, exact):
        names = np.array([np.abs(x - v).sum(1).argmin() for v in y])
        for q, v in found(y, member, query, True):
            kept = ~lost[names[q], names[v]]
            yield q[kept], v[kept]

    monkeypatch.setattr(embeddings, "tuned", lambda nodes: (embeddings.Cells({"1/3": embeddings.refined(x, 6)}, {"1/3": embeddings.distance_of(embeddings.COSINE)}, {}), {}))
    df = spark.createDataFrame([(i, v, 1) for v, i in ((list(k), i) for k, i in rows.items())], "vec_id long, embedding array<float>, label int")
    real = embeddings.linked

    def linked(batches, exact, pairs):
        embeddings.pairs_of_shard = forgetful
        try:
            yield from real(batches, exact, pairs)
        finally:
            embeddings.pairs_of_shard = found

    monkeypatch.setattr(embeddings, "linked", linked)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert [got[i] for i in range(400)] == near.sum(1).tolist()


def test_ends_that_differ_are_searched_again(spark, monkeypatch):
    """The search for the pairs of some nodes, by the functions that tasks really run."""
    x = embeddings.unit(np.random.default_rng(6).normal(size=(400, 3)))
    near = x @ x.T >= embeddings.COSINE
    np.fill_diagonal(near, False)
    nodes = spark.createDataFrame([(i, 1, "1/3", v.tolist()) for i, v in enumerate(x)], "node long, n long, group string, embedding array<double>")
    found = embeddings.searched(nodes, embeddings.Cells({}, {}, {}), False, "pairs", spark.range(0, 400, 7).withColumnRenamed("id", "node"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a in range(0, 400, 7) for b in np.flatnonzero(near[a]).tolist()}


def test_a_dense_shard_is_searched_in_little_memory(monkeypatch):
    r = np.random.default_rng(9)
    x = embeddings.unit(np.concatenate([r.normal(size=32) + 0.015 * r.normal(size=(4000, 32)), r.normal(size=(500, 32))]))
    graph, some = embeddings.Graph(x), np.arange(256)
    tracemalloc.start()
    whole = set(zip(*(c.tolist() for c in graph.within(x[some], some)), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(whole) == (x[some] @ x.T >= embeddings.COSINE).sum()
    assert peak < 4e8  # 900 MB where all edges are followed at once
    monkeypatch.setattr(embeddings, "EDGES", 5000)
    assert set(zip(*(c.tolist() for c in graph.within(x[some[:40]], some[:40])), strict=True)) == {(q, v) for q, v in whole if q < 40}
    alone = embeddings.Graph(x[:1])
    assert [c.tolist() for c in alone.within(x[:1], np.zeros(1, np.int64))] == [[0], [0]]


def test_the_exact_way_goes_without_cells_where_all_are_guests(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MEMBERS", 100)
    r = np.random.default_rng(10)
    wide, flat = embeddings.unit(r.normal(size=(600, 64))), embeddings.unit(r.normal(size=(600, 2)))
    rows = [(i, 1, g, v.tolist()) for i, (g, v) in enumerate([*(("1/64", v) for v in wide), *(("2/2", v) for v in flat)])]
    nodes = spark.createDataFrame(rows, "node long, n long, group string, embedding array<double>")
    cells = embeddings.Cells({"1/64": embeddings.refined(wide, 12), "2/2": embeddings.refined(flat, 12)}, {"1/64": 0.06, "2/2": 0.06}, {})
    made = embeddings.exhaustive_cells(nodes, cells, ["1/64", "2/2"])
    assert list(made.centres) == ["2/2"] and made.reach["2/2"] == embeddings.distance_of(embeddings.COSINE)
    found = {r["node"]: r["n_links"] for r in embeddings.searched(nodes, made, True, "exact").groupBy("node").agg(F.sum(F.when(F.col("asks"), F.col("n_links"))).alias("n_links")).collect()}
    for at, x in ((0, wide), (600, flat)):
        assert [found[at + i] for i in range(600)] == ((x @ x.T >= embeddings.COSINE).sum(1) - 1).tolist()


def test_many_texts_of_one_id(spark, make_docs, monkeypatch):
    """Each text meets its own set alone, not those of all texts of its id."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(30)) for _ in range(150)]
    rows = [(7, t) for t in texts] + [(7, t + " end") for t in texts] + [(9, texts[0])]
    met = []
    made = minhash.full_sets

    def counted(df, k, similar):
        met.append(df.count())
        return made(df, k, similar)

    monkeypatch.setattr(minhash, "full_sets", counted)
    found = minhash.near_duplicates(make_docs(rows)).collect()
    assert len(found) == 301 and {r["component_id"] for r in found} == {7} and met == [300]
