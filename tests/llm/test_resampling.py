"""Importance resampling against a plain version; runs, ranges and the tournament at small bounds."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from keelvault.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    found = WORD.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]


def plain(docs, target, percent, least, longest, buckets):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in (([x[1] for x in docs], s), (target, t)):
        for text in texts:
            for g in grams(text, longest)[1]:
                counts[place(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text, *_ in docs:
        n, found = grams(text, longest)
        weight = sum(gain[place(g)] for g in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((n >= least, doc_id, len(found), weight, score))
    order = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = len(order) * percent // 100
    return sorted([(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(order)] + [(*r[1:], None) for r in rows if not r[0]], key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["Ünit", "the", "THE", "of", "x9", "alpha", "Beta", "日本", "q" * 70, "don't", "a-b", "é"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", ".", "\x00"])) for i in range(n)]
    return rows + [(rows[5][0], rows[5][1])] * 40 + [(None, rows[7][1])] * 30 + [(None, None), (n, None), (n + 1, ""), (n + 2, rows[9][1]), (n + 3, rows[9][1])]


@pytest.mark.parametrize(("longest", "bounds"), [(1, {}), (3, {"run_rows": 37, "block_rows": 5, "range_rows": 29}), (1, {"run_rows": 16, "block_rows": 4, "range_rows": 10, "percent": 55}), (1, {"percent": 100, "range_rows": 50}), (2, {"percent": 0})])
def test_resample(spark, make_docs, longest, bounds):
    docs, target = corpus(longest), ["the Alpha of x9 x9", None, "beta 日本"]
    percent = bounds.get("percent", 10)
    want = plain(docs, target, percent, 20, longest, 97)
    got = resampling.resample(make_docs(docs).repartition(6), spark.createDataFrame([(t, 1) for t in target], "text string, rank int"), longest=longest, buckets=97, **bounds)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_odd_rows(spark, make_docs, odd_rows):
    target = ["one two w1 w1"]
    got = resampling.resample(make_docs(odd_rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=100, least_words=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(odd_rows, target, 100, 1, 1, 10_000)


def test_empty(spark, make_docs):
    none, texts = make_docs([(1, "a")]).limit(0), spark.createDataFrame([("a",)], "text string")
    assert resampling.resample(none, texts).count() == 0
    docs = make_docs([(i, "word " * 30) for i in range(20)])
    assert resampling.resample(docs, texts.limit(0)).filter("rank IS NOT NULL").count() == 2


def test_drawn(spark, make_docs):
    docs = make_docs([(i, f"w{i} " * 30) for i in range(50)])
    taken = resampling.drawn(docs, resampling.resample(docs, spark.createDataFrame([("w7 w8",)], "text string")))
    assert taken.columns == [*docs.columns, "rank"] and sorted(r["rank"] for r in taken.collect()) == [1, 2, 3, 4, 5]


def test_many_equal_rows_are_one_entry(spark, make_docs):
    docs = make_docs([(5, "same word " * 15)] * 3000 + [(i, f"w{i} " * 25) for i in range(100, 400)])
    rows = resampling.scored(docs, resampling.gains(np.ones(50, np.int64), np.arange(50)))
    runs = resampling.sorted_runs(rows.repartition(3, "weight")).collect()
    assert sum(len(r["many"]) for r in runs) <= 300 + 3 and sum(map(sum, (r["many"] for r in runs))) == 3300


def test_crc32s():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 400)
    ends = starts + rng.integers(0, 200, 400) * rng.integers(0, 2, 400)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert resampling.crc32s(data, starts, ends).tolist() == want
    assert resampling.crc32s(data, starts[:0], ends[:0]).tolist() == []


@pytest.mark.parametrize("seed", range(6))
def test_tournament(seed):
    """Pieces in the order of their first keys come out merged, and no piece is opened before it is needed."""
    rng = random.Random(seed)
    pieces = sorted(sorted((rng.randint(0, 90), rng.randint(0, 3)) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))
    opened = []

    def stream():
        for p in pieces:
            opened.append(p)
            yield p, [1] * len(p)

    out = []
    for key, _ in resampling.merged(stream()):
        out.append(key)
        assert all(p[0] <= key for p in opened[:-1])  # all but the one that is looked at
    assert out == sorted(k for p in pieces for k in p)


def test_merge_stops_early():
    read = []

    def stream():
        for i in range(1000):
            read.append(i)
            yield [(i, 0), (i, 1)], [1, 1]

    merge = resampling.merged(stream())
    assert [next(merge)[0] for _ in range(6)] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)] and len(read) < 6
