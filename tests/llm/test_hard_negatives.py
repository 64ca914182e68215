"""Hard negatives against all pairs in plain Python; trees and their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelvault.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, cell string, rank string, number string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "r", "n") for r in rows], SCHEMA)


def plain(rows, anchors, k=5, m=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score) over distinct rows that take part."""
    part = []
    for i, label, vec in dict.fromkeys((i, label, None if v is None else tuple(v)) for i, label, v in rows if v is None or all(x == x for x in v if x is not None)):
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        part.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = []
    for i, label, q in part:
        if not anchors(i):
            continue
        score = lambda r, q=q: sum(a * b for a, b in zip(q, r[2], strict=True))
        other = sorted((-score(r), r[0], r[1]) for r in part if r[0] != i and len(r[2]) == len(q))
        for s, p, _ in [x for x in other if x[2] == label][:k]:
            hard = [x for x in other if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(i, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(hard)]
    return sorted(out)


def clustered(seed, n, d, labels, spread):
    """Vectors around a few directions that labels share, so that there are hard negatives."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    x = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(0, labels)), [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "labels", "options"), [(300, 16, 3, {}), (700, 8, 5, {"shard": 64, "leaf": 4, "anchor_values": 100}), (500, 3, 2, {"shard": 50, "leaf": 1}), (400, 6, 200, {"shard": 128, "leaf": 8, "n_positives": 2, "n_negatives": 3, "low": 95, "high": 99})])
def test_mine(spark, n, d, labels, options):
    rows = clustered(n, n, d, labels, 0.3)
    got = hn.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    given = {"n_positives": "k", "n_negatives": "m", "low": "low", "high": "high"}
    want = plain(rows, lambda i: i % 10 == 0, **{given[k]: v for k, v in options.items() if k in given})
    assert want and sorted(map(tuple, got.collect())) == want


def test_ties_and_copies(spark):
    """Few different vectors: almost every score is a tie, and rows repeat."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(v) for v in rng.integers(0, 3, 4)]) for i in range(300)]
    rows += [rows[0]] * 200 + [rows[10]] * 5 + [(20, 1, [2.0, 2.0, 2.0, 2.0]), (20, 2, [2.0, 1.0, 2.0, 2.0])]
    got = hn.mine(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, shard=40, leaf=4)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = clustered(2, 60, 5, 2, 0.2)
    odd = [(None, 1, good[0][2]), (100, None, good[0][2]), (110, 1, None), (120, 1, [1.0, None, 0.0, 0.0, 0.0]), (130, 1, [nan] * 5), (140, 1, [inf, 0.0, 0.0, 0.0, 0.0]), (150, 1, []), (160, 0, []), (170, 1, []), (180, 1, [0.0] * 5), (190, 0, [-1.0] * 5), (200, 1, [1.0, 2.0]), (210, 1, [1.0, 2.0]), (211, 0, [1.0, 1.9]), (220, 0, [3.0])]
    got = hn.mine(frame(spark, good + odd), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain(good + odd, lambda i: i % 10 == 0)


def test_empty(spark):
    none = frame(spark, [(1, 1, [1.0])]).limit(0)
    assert hn.mine(none, F.col("vec_id") % 10 == 0).count() == 0
    assert hn.mine(frame(spark, [(1, 1, [1.0]), (2, 1, None)]), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.mine(frame(spark, [(i, i % 2, [1.0, float(i)]) for i in range(6)])).count() > 0  # all rows are anchors


def test_large_components():
    a = np.array([[1 << 27, 3]])
    assert hn.dots(a, a).tolist() == [[(1 << 54) + 9]]
    with pytest.raises(ValueError, match="56 bits"):
        hn.dots(a * 4, a)
    with pytest.raises(ValueError, match="56 bits"):
        hn.floored(np.array([[1e30]]), 256)


@pytest.mark.parametrize("labels", [1, 4, 500])
def test_tree(labels):
    rng = np.random.default_rng(labels)
    q, names = rng.integers(-200, 200, (1000, 6)), rng.integers(0, labels, 1000)
    tree = hn.unpacked(hn.packed(np.arange(1000), names, q, 16))
    assert sorted(tree["ids"].tolist()) == list(range(1000)) and (tree["q"] == q[tree["ids"]]).all() and (tree["labels"] == names[tree["ids"]]).all()
    anchors = rng.integers(-200, 200, (50, 6))
    for node in range(len(tree["start"])):
        rows = slice(tree["start"][node], tree["end"][node])
        scores = anchors @ tree["q"][rows].T
        middle, reach = anchors @ tree["centre"][node], np.linalg.norm(anchors, axis=1) * tree["radius"][node]
        assert (scores.max(1) <= middle + reach + 1e-6).all() and (scores.min(1) >= middle - reach - 1e-6).all()
        assert tree["low"][node] == tree["labels"][rows].min() and tree["high"][node] == tree["labels"][rows].max()
        a, b = tree["left"][node], tree["right"][node]
        assert a < 0 or (tree["start"][a], tree["end"][a], tree["end"][b]) == (rows.start, tree["start"][b], rows.stop)
        assert a >= 0 or rows.stop - rows.start <= 16


def test_bounds_prune():
    """Of tight clusters only few leaves are scored, in both directions of the window."""
    rng = np.random.default_rng(1)
    centres = np.repeat(np.linalg.qr(rng.normal(size=(16, 16)))[0], 256, 0)
    q = np.floor(256 * (centres + 0.01 * rng.normal(size=centres.shape))).astype(np.int64)
    labels, ids = np.arange(len(q)) % 2, np.arange(len(q))
    tree = hn.unpacked(hn.packed(ids, labels, q, 32))
    leaves = int((tree["left"] < 0).sum())
    best = hn.Search(ids[:50], labels[:50], q[:50], True, 5)
    best.visit(tree)
    assert best.leaves < 50 * leaves / 8
    low, high = np.full((50, 1), 30_000), np.full((50, 1), 50_000)  # between the clusters: nothing
    window = hn.Search(ids[:50], labels[:50], q[:50], False, 5, 1, low, high)
    window.visit(tree)
    assert window.leaves == 0 and (window.found == hn.NO_ID).all()
