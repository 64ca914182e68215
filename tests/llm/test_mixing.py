import re

from keelvault.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    """Shares by weight; what is above twice a source's size is shared again by weight, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, excess = sum(weights[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            out[s] += left * weights[s] / total
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                excess += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = excess
    return out


def corpus():
    rows = [(i, " ".join(f"w{j}" for j in range((i * 7) % 23)), ["a", "b", "ä", "Z", None][min(i % 9, 4)]) for i in range(300)]
    return [*rows, (3, rows[3][1], "a"), (3, rows[3][1], "a"), (500, None, "only null"), (None, "x y z", "b")]


def test_mix(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = expected_targets(sizes)
    for source in sizes:
        own = [r for r in found if r["source"] == source]
        assert all(abs(r["target"] - targets[source]) < 1e-6 and r["source_size"] == sizes[source] and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert sum(r["taken"] for r in own) == int(targets[source] + 0.5)


def test_apply(make_docs):
    docs = make_docs(corpus())
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    for r in mixing.mix(docs).groupBy("source").sum("taken").collect():
        assert words.get(r["source"], 0) == r["sum(taken)"]


def test_empty(make_docs):
    docs = make_docs([(1, "a")]).limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.apply_mix(docs).count() == 0
    assert mixing.mix(make_docs([(1, None), (2, "")])).agg({"taken": "sum"}).first()[0] == 0


def test_odd_rows_and_long_texts(make_docs, odd_rows):
    """Rows equal in id and text share what is due; a very long text is cut to the word; a budget may end in it."""
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = make_docs([*odd_rows, (70, long, "long"), (71, "a b c", "long"), *[(72, "same row here", "many")] * 9])
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert len({r["taken"] for r in found if r["doc_id"] == 72}) == 1
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9
    words = [len(WORD.findall(r["text"])) for r in mixing.apply_mix(docs).filter("source = 'long'").collect()]
    assert sum(words) == sum(r["taken"] for r in found if r["source"] == "long")
