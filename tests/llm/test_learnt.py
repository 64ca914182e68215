"""Quality and toxicity: held-out accuracy on invented texts, and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelvault.llm import quality, toxicity

SYLLABLES = ["an", "er", "on", "th", "ing", "ou", "re", "st", "ha", "li"]


def corpus(n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(20, 150))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = "vek" + r.choice(SYLLABLES)
        if bad:
            words = [w + r.choice(["***", "###", "%%%"]) for w in words]
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels, {i: (q, t) for i, q, t in labels}


@pytest.fixture(scope="module")
def setting(spark, make_docs):
    rows, labels, truth = corpus()
    return make_docs(rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), truth


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def accuracy(found, truth, which, threshold):
    pairs = [(s >= threshold, truth[i][which]) for i, s in found.items() if held_out(i) and i in truth]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_toxicity(setting, make_docs, odd_rows):
    docs, labels, truth = setting
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert accuracy(found, truth, 1, toxicity.THRESHOLD) > 0.95
    odd = toxicity.score(make_docs(odd_rows), model)
    assert odd.count() == len(odd_rows) and set(make_docs(odd_rows).columns) < set(odd.columns)
    scores = [(r["text"], r["toxicity"]) for r in odd.collect()]
    assert all(0 <= s <= 1 for _, s in scores) and len({s for t, s in scores if not (t or "").strip()}) == 1
    assert all(s < toxicity.THRESHOLD for t, s in scores if not t)
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_ignores_held_out_labels(setting):
    docs, labels, _ = setting
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r["doc_id"], r["toxicity"]) for r in toxicity.score(docs, toxicity.train(docs, x)).collect()) for x in (labels, turned))
    assert one == two


def test_quality(setting, make_docs, odd_rows):
    docs, labels, truth = setting
    net = quality.train(docs, labels)
    found = {r["doc_id"]: r["quality_"] for r in quality.score(docs, net).collect()}
    assert accuracy(found, truth, 0, 0.5) > 0.9
    odd = [(r["text"], r["quality_"]) for r in quality.score(make_docs(odd_rows), net).collect()]
    assert len(odd) == len(odd_rows) and all(0 <= s <= 1 for _, s in odd)
    assert quality.score(docs.limit(0), net).count() == 0


def test_quality_of_short_texts_and_of_its_own_column(setting, make_docs):
    docs, labels, _ = setting
    net = quality.train(docs, labels)
    odd = make_docs([(1, None), (2, ""), (3, "a"), (4, "a"), (5, "ab"), (5, "ab"), (6, "abcdefg"), (7, "abcdefgh"), (8, "abcdefgX")])
    assert "quality" in odd.columns
    found = {r["doc_id"]: (r["quality"], r["quality_"]) for r in quality.score(odd, net).collect()}
    assert {q for q, _ in found.values()} == {"q"} and found[1] == found[2] and found[3] == found[4]
    assert found[7][1] != found[8][1]  # the last byte counts


def test_quality_passes_over_a_text_that_is_too_large(spark, setting, make_docs):
    """One text of more than all training bytes doesn't end the choice of rows."""
    docs, _, truth = setting
    first = spark.range(3000).selectExpr("id").orderBy(F.xxhash64("id")).first()["id"]  # comes before all other rows
    rows = [r for r in corpus()[0] if r[0] != first]
    labels = spark.createDataFrame([(i, q) for i, (q, _) in truth.items()] + [(first, 1)], "doc_id long, quality int")
    net = quality.train(make_docs([*rows, (first, "übung " * (quality.TRAIN_BYTES // 6))]), labels)
    assert net is not None


def test_quality_ignores_held_out_labels(setting):
    docs, labels, _ = setting
    turned = labels.withColumn("quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r["doc_id"], r["quality_"]) for r in quality.score(docs, quality.train(docs, x)).collect()) for x in (labels, turned))
    assert one == two


def plain_pooled(net, text):
    """A text's features by loops over places, hops and chunks."""
    text = text + bytes(quality.WIDTH - len(text)) if 0 < len(text) < quality.WIDTH else text
    act = [sum(net["table"][k, text[i + k]] for k in range(quality.WIDTH)) for i in range(len(text) - quality.WIDTH + 1)]
    hops = [np.max(act[i : i + quality.HOP], 0) for i in range(0, len(act), quality.HOP)]
    chunks = [np.maximum(a, b) for a, b in zip(hops, hops[1:], strict=False)] if len(hops) > 1 else hops
    value = [np.maximum(c + net["bias"], 0) for c in chunks]
    return np.concatenate([np.mean(value, 0), np.max(value, 0)]) if value else np.zeros(2 * quality.FILTERS)


def test_quality_features_and_gradients_are_those_of_loops(monkeypatch):
    r = np.random.default_rng(4)
    net = quality.fit([b"some words", b"other ***"], np.array([1.0, 0.0]))
    texts = [bytes(r.integers(1, 255, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 9, 100, 256 + 7, 256 + 8, 600, 1500)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    whole = quality.pooled(net["table"], net["bias"], data, off)
    for row, text in zip(whole, texts, strict=True):
        assert np.allclose(row[:-1], plain_pooled(net, text), atol=1e-4)
    monkeypatch.setattr(quality, "SLICE", 512)  # in slices
    assert np.allclose(quality.pooled(net["table"], net["bias"], data, off), whole)
    y = np.array([1.0, 0, 1, 0, 1, 0, 1, 0, 1, 0])
    net = {k: np.asarray(v, np.float64) for k, v in net.items()}

    def loss(net):
        p = quality.head(net, quality.pooled(net["table"], net["bias"], data, off).astype(float))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality.gradients(net, data, off, y)
    for name in ("w2", "b1", "bias", "w1"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), np.shape(grads[name]))
        up, down = ({**net, name: net[name].copy()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert np.isclose((loss(up) - loss(down)) / 2e-3, grads[name][at], rtol=0.05, atol=1e-4), name


def test_without_labels(setting):
    docs, labels, _ = setting
    assert toxicity.train(docs, labels.limit(0)) is None and quality.train(docs, labels.filter("quality = 1")) is None
    assert toxicity.score(docs, None).agg({"toxicity": "max"}).first()[0] == 0.0


def test_toxicity_counts_every_labelled_row_but_those_that_fit(setting, monkeypatch):
    docs, labels, truth = setting
    counted, models = [], toxicity.kneser_ney
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    monkeypatch.setattr(toxicity, "kneser_ney", lambda kind, toxic, ordinary, documents: counted.append((toxic.count() + ordinary.count(), documents.count())) or models(kind, toxic, ordinary, documents))
    toxicity.train(docs, labels)
    assert counted == [(sum(not held_out(i) for i in truth) - 40, docs.count())] * 2


def test_toxicity_labels_meet_texts_by_either_join(setting, monkeypatch):
    docs, labels, _ = setting
    one = sorted((r["doc_id"], r["toxicity"]) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert one == sorted((r["doc_id"], r["toxicity"]) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())


def test_toxicity_without_expressions(spark, make_docs):
    """Too few toxic texts for any expression: a score all the same."""
    docs = make_docs([(i, "one word" if i % 2 else "two more") for i in range(30)])
    labels = spark.createDataFrame([(i, int(i in (3, 4))) for i in range(30) if not held_out(i)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, model).collect())


def test_toxicity_carries_a_column_of_its_name(setting):
    docs, labels, _ = setting
    own = docs.withColumn("toxicity", F.lit("mine")).withColumn("_key", F.lit(1))
    scored = toxicity.score(own, toxicity.train(own, labels))
    assert scored.columns == [*own.columns, "toxicity_"] and {r["toxicity"] for r in scored.collect()} == {"mine"}
    kept = toxicity.reject(own, labels)
    assert kept.columns == own.columns and 0 < kept.filter("toxicity = 'mine'").count() == kept.count() < docs.count()


def plain_ratios(toxic, ordinary, order, starts, letters=False):
    """Interpolated Kneser-Ney on dictionaries: a function from a list of elements to the log ratio of each but leading marks, by
    the longest sequence.  starts: marks that stand before each list; letters: sequences that begin with one count occurrences."""
    counts = []
    for texts in (toxic, ordinary):
        seen, own = {}, {}
        for ws in texts:
            ws = [*starts, *ws]
            for k in range(1, order + 1):
                for i in range(len(starts), len(ws)):
                    if i - k + 1 >= 0:
                        g = tuple(ws[i - k + 1 : i + 1])
                        seen[g] = seen.get(g, 0) + 1
        for g, n in seen.items():
            if len(g) == order or (letters and len(g) > 1 and g[: len(starts)] == tuple(starts)):
                own[g] = n
            if len(g) > 1:
                own[g[1:]] = own.get(g[1:], 0) + 1 if not (letters and len(g) > 2 and g[1:2] == tuple(starts)) else own[g[1:]]
        after = {}
        for g, n in own.items():
            after.setdefault(g[:-1], []).append(n)
        counts.append((own, after))
    elements = len({g for own, _ in counts for g in own if len(g) == 1}) + 1

    def likely(g, c):
        own, after = counts[c]
        under = likely(g[1:], c) if g[1:] else 1 / elements
        follows = after.get(g[:-1])
        return (max(own.get(g, 0) - 0.75, 0) + 0.75 * len(follows) * under) / sum(follows) if follows else under

    def ratio(ws, i, k):
        g = tuple(ws[max(0, i - k + 1) : i + 1])
        return math.log(likely(g, 0)) - math.log(likely(g, 1))

    return lambda ws, k=order: [ratio([*starts, *ws], i, k) for i in range(len(starts), len(starts) + len(ws))]


@pytest.mark.parametrize("common", [1 << 22, 3])
def test_toxicity_ratios_are_those_of_the_formula(spark, make_docs, monkeypatch, common):
    """Rare sequences and those of one class alone count too; all ratios of letters broadcast, and nearly all of them joined."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefgh") + r.choice("xy") * (r.random() < 0.3) for _ in range(r.randint(1, 40))), i % 3 == 0) for i in range(60)]
    monkeypatch.setattr(toxicity, "COMMON", common)
    frames = [spark.createDataFrame([(t,) for _, t, c in rows if c == which], "text string") for which in (True, False)]
    docs = make_docs([*((i, t) for i, t, _ in rows), (99, "A, a! b-b;zz never seen"), (100, None)])
    tables = {kind: toxicity.kneser_ney(kind, *frames, docs.select("text")) for kind in toxicity.ORDERS}
    split = lambda t: "".join(x if x.isalnum() else " " for x in (t or "").lower()).split()
    by_class = [[split(t) for _, t, c in rows if c == which] for which in (True, False)]
    words = plain_ratios(*by_class, 3, [None, None])
    spell = lambda texts: [f"{w} " for t in texts for w in t]
    letters = plain_ratios(*map(spell, by_class), 8, " ", letters=True)
    found = {row["doc_id"]: row for row in toxicity.rated(docs, tables).collect()}
    assert len(found) == len(rows) + 2
    clip = lambda x: max(-toxicity.MOST, min(toxicity.MOST, x))
    for row in found.values():
        text = split(row["text"])
        for part, want in enumerate([*(words(text, k) for k in (1, 2, 3)), [sum(letters(f"{w} ")) for w in text]]):
            got = [row[f] for f in toxicity.FEATURES[part * 6 : part * 6 + 6]]
            want = list(map(clip, want))
            best = sorted({w: max(x for v, x in zip(text, want, strict=True) if v == w) for w in text}.values(), reverse=True)[: toxicity.TOP]
            passages = [max((sum(want[i : i + k]) / k for i in range(len(want))), default=0) for k in toxicity.PASSAGES]
            assert got == pytest.approx([*passages, sum(want) / max(len(want), 1), sum(best) / toxicity.TOP], abs=1e-4)


def test_toxicity_in_parts_runs_and_shares(setting, monkeypatch):
    """Many parts, short runs of words and several shares of the texts give the same features."""
    docs, labels, _ = setting
    toxic, ordinary = (docs.join(labels.filter(F.col("toxic") == which), "doc_id", "left_semi").select("text") for which in (1, 0))

    def features():
        tables = {kind: toxicity.kneser_ney(kind, toxic, ordinary, docs.select("text")) for kind in toxicity.ORDERS}
        return {r["doc_id"]: [r[f] for f in toxicity.FEATURES] for r in toxicity.rated(docs, tables).collect()}

    one = features()
    monkeypatch.setattr(toxicity, "TASK_KEYS", 1 << 11)
    monkeypatch.setattr(toxicity, "SLICE", 1 << 12)
    monkeypatch.setattr(toxicity, "PART_ROWS", 60)
    two = features()
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-4) for i in one)


def test_toxicity_tables_say_each_thing_once(setting):
    """A part's table is one row of its pairs, one of triples and one of words, so that it isn't summed again for each share of the texts."""
    docs, labels, _ = setting
    toxic, ordinary = (docs.join(labels.filter(F.col("toxic") == which), "doc_id", "left_semi").select("text") for which in (1, 0))
    rows = toxicity.kneser_ney(toxicity.WORDS, toxic, ordinary, docs.select("text")).rows
    found = {(r["part"], r["kind"]): r["count"] for r in rows.groupBy("part", "kind").count().collect()}
    assert found and set(found.values()) == {1}


def test_toxicity_packs_no_bytes_that_are_zero():
    r = np.random.default_rng(5)
    keys, counts = np.sort(r.integers(0, 1 << 48, 5000, dtype=np.uint64)), [r.integers(0, 2, 5000).astype(np.uint32) for _ in range(5)]
    (blob,) = toxicity.packed(0, 0, toxicity.KNOWN, keys, *counts)["blob"].to_pylist()
    assert list(blob[:6]) == [max(1, -(-int(np.diff(keys, prepend=keys[:1] * 0).max()).bit_length() // 8)), 1, 1, 1, 1, 1]
    for one, two in zip(toxicity.unpacked(toxicity.KNOWN, 5000, blob), [keys, *counts], strict=True):
        assert one.dtype == two.dtype and (one == two).all()
    (blob,) = toxicity.packed(0, 0, toxicity.SPELT, keys, -counts[0].astype(np.float32))["blob"].to_pylist()
    assert (toxicity.unpacked(toxicity.SPELT, 5000, blob)[1] == -counts[0].astype(np.float32)).all()


def test_toxicity_orders_and_hashes_as_the_plain_ways():
    r = np.random.default_rng(6)
    keys = r.integers(0, 40, 3000, dtype=np.uint64)
    more = r.integers(0, 3, 3000, dtype=np.uint64) << np.uint64(32) | r.integers(0, 50, 3000, dtype=np.uint64)  # upper bits tie
    by, plain = toxicity.ordered(keys, more), np.lexsort((more, keys))
    assert (keys[by] == keys[plain]).all() and (more[by] == more[plain]).all() and len(np.unique(by)) == 3000
    data = np.frombuffer("A few words, übung x 日本 zz".encode() * 50, np.uint8)
    starts, ends, _ = toxicity.words(data, np.array([0, len(data)]), toxicity.APART)
    assert (toxicity.folded_hashes(data, starts, ends) == toxicity.word_hashes(data, starts, ends, fold=True)).all()


def test_toxicity_finds_the_highest_words_of_every_text():
    """Also of texts whose words are all low, have few different ones, or none."""
    r = np.random.default_rng(7)
    size = np.array([0, 1, 2, 400, 3, 0, 900, 50])
    hashes = r.integers(0, 60, size.sum(), dtype=np.uint64)
    hashes[-50:] = 7
    value = np.concatenate([r.normal(-5 if n == 900 else 0, 1, n) for n in size])
    first = np.concatenate([[0], np.cumsum(size)])
    found = toxicity.features(value, first, hashes)[:, -1]
    for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        best = sorted({h: max(v for g, v in zip(hashes[a:b], np.clip(value[a:b], -6, 6), strict=True) if g == h) for h in hashes[a:b]}.values(), reverse=True)[: toxicity.TOP]
        assert found[i] == pytest.approx(sum(best) / toxicity.TOP)


def test_toxicity_letters_take_few_stages(spark):
    """The driver keeps what it knows of each stage and task, so the sizes of sequences aren't joined one after the other."""
    words = spark.createDataFrame([(i, bytearray(w.encode()), i % 2, 1) for i, w in enumerate(["a", "bad", "badly", "übung", "longer1than2eight"])], "word long, bytes binary, toxic long, ordinary long")
    sc = spark.sparkContext
    sc.setJobGroup("toxicity-letters", "")
    try:
        assert toxicity.spelt_model(words).count() > 30
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("toxicity-letters") for s in tracker.getJobInfo(job).stageIds}
    assert 0 < len(stages) < 20


@pytest.mark.parametrize("kind", ["long", "string"])
def test_toxicity_shares_hold_each_row_once(spark, tmp_path, kind):
    """Also rows without an id and of one id; those of whole numbers are ranges that pass over row groups."""
    rows = [*range(200), *[7] * 50, *[None] * 9]
    spark.createDataFrame([(i, str(i)) for i in rows], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    shares = toxicity.shares(docs, 4)
    found = [docs.filter(s) for s in shares]
    assert len(shares) == 4 and sum(f.count() for f in found) == len(rows) and all(f.count() for f in found)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
    assert all(("GreaterThanOrEqual(doc_id" in p or "LessThan(doc_id" in p) == (kind == "long") for p in plans)
    assert len(toxicity.shares(docs.limit(0), 4)) in (1, 4)
