"""The pipeline's stages on their own inputs, against plain versions, and the registered queries."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from keelvault.llm import pii, toxicity
from keelvault.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    """Documents with copies, near copies, personal data, insults, nulls, empty texts, repeated rows and ids, and their labels."""
    r = random.Random(21)
    base = ["ren", "tal", "mio", "sek", "vor", "pul", "dan", "gi", "lo", "ba"]
    rows, labels = [], []
    for i in range(360):
        words = ["".join(r.choices(base, k=r.randint(1, 3))) for _ in range(r.randint(5, 70))]
        bad = i % 6 == 0
        for _ in range(4 * bad):
            words.insert(r.randrange(len(words)), "zhukk" + r.choice(base))
        if i % 9 == 1:
            words.insert(r.randrange(len(words)), f"user{i}@mail.example.org")
        if i % 9 == 2:
            words.insert(r.randrange(len(words)), f"+1 (555) 123-{1000 + i}")
        rows.append((i, " ".join(words), "en", r.choice("abc"), len(" ".join(words))))
        if r.random() < 0.8:
            labels.append((i, 1, int(bad)))
    for i in range(400, 440):
        _, text, lang, source, _ = rows[r.randrange(360)]
        words = text.split(" ")
        if i % 2 and len(words) > 30:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang, source, len(" ".join(words))))
    rows += [(500, None, "en", "a", None), (501, "", "en", "b", 0), (502, None, None, None, None), (None, rows[3][1], "en", "a", 9), rows[5], rows[5], (504, "ΣΑΣ café 日本 😀", "el", None, 14)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def plain_minhash(rows):
    """Of each group, linked by exact sets of five words, the row with the smallest id stays."""
    def shingles(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept = {}
    for row, s, g in zip(rows, sets, group, strict=True):
        key = g if s else ("empty", len(kept))
        if key not in kept or (row[0] is None, row[0]) < (kept[key][0] is None, kept[key][0]):
            kept[key] = row
    return sorted(kept.values(), key=str)


def plain_mix(rows, seed=7):
    """The whole order of each source, taken up to its budget."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = {s: sum(n for r, n in zip(rows, size, strict=True) if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = dict.fromkeys(sources, 0.0), set(sources), 1.5 * sum(size)
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - 2 * total[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * total[s]:
                target[s] = 2.0 * total[s]
                open_.discard(s)
    out = []
    for s in sources:
        budget = math.floor(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest, order = budget - epochs * total[s], []
        for r, n in zip(rows, size, strict=True):
            if r[3] == s:
                text = r[1] or ""
                u = (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = 0.25 + 0.75 * (len(text) - len(regex.findall(r"[^\p{L}\x09-\x0D\x20]", text))) / len(text) if text else 0.25
                order.append((-math.log(u) / w, r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64), n, r))
        for _, _, _, _, n, r in sorted(order, key=lambda o: o[:4]):
            part = min(n, rest)
            rest -= part
            out += [r] * (epochs if n else 0)
            if part == n and n:
                out.append(r)
            elif part:
                text = " ".join(WORD.findall(r[1])[:part])
                out.append((r[0], text, r[2], r[3], len(text)))
    return sorted(out, key=str)


def test_stages_and_run(spark, directory, tmp_path):
    before = spark.read.parquet(f"{directory}/documents.parquet")
    library, last = Tokenizer.from_file(vocabulary_path()), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, directory)
        out.write.parquet(str(tmp_path / name))
        after, given = spark.read.parquet(str(tmp_path / name)), rows_of(before)
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{directory}/labels.parquet")))
            assert rows_of(after) == rows_of(scored.filter(scored["toxicity"] < toxicity.THRESHOLD))
            bad = [r for r in given if "zhukk" in (r[1] or "")]
            gone = {r[0] for r in given} - {r[0] for r in rows_of(after)}
            assert len(gone & {r[0] for r in bad}) > 0.9 * len({r[0] for r in bad}) and not gone - {r[0] for r in bad}
        elif name == "minhash":
            want = plain_minhash(given)
            assert rows_of(after) == want and len(want) < len(given)
        elif name == "pii":
            spans = {(r["doc_id"], r["row"]): r for r in pii.find(before).collect()}
            assert after.columns == COLUMNS and after.count() == len(given)
            texts = {r[0]: r[1] for r in rows_of(after)}
            found = {k[0]: r["spans"] for k, r in spans.items()}
            for i, text, *_ in given:
                base = pii.base_spans(text or "")
                assert {pii.spell([s]) for s in base} <= set(found[i].split(",")) | {""}
                assert texts[i] == pii.masked(text, found[i]) and (not base or not pii.base_spans(texts[i]))
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows_of(after))
        elif name == "mixing":
            assert rows_of(after) == plain_mix(given)
        else:
            got = sorted((str(r["doc_id"]), r["ids"], r["n_tokens"]) for r in after.collect())
            ids = [(str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in given]
            assert got == sorted((i, x, len(x)) for i, x in ids) and after.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
            last = sorted(map(str, after.collect()))
        before = after
    assert sorted(map(str, corpus_pipeline.run(spark, directory).collect())) == last


def test_stages_over_odd_columns(spark, directory, make_docs, odd_rows):
    """Nulls in every column, and columns with the names of results, come through each stage; clean documents stay."""
    clash = ["toxicity", "component", "spans", "target", "ids"]
    docs = make_docs([*odd_rows, (None, None, None)]).select("doc_id", "text", "source", "lang", "n_chars", *(f.alias(c) for f, c in zip(spark_nulls(), clash, strict=True)))
    docs = docs.unionByName(docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, directory)
        assert after.columns == docs.columns, name
        if name in ("toxicity", "pii"):
            assert after.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, directory).count() == docs.count()


def spark_nulls():
    """A value, a null, and values of other types than the results of those names have."""
    return F.lit("own"), F.lit(None).cast("long"), F.lit(3), F.lit(None).cast("string"), F.lit("x")


def test_empty_tables(spark, directory, tmp_path):
    spark.read.parquet(f"{directory}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{directory}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_pii", "op2_quality", "op4_bpe", "op5_fingerprint", "op10_toxicity"])
def test_registered_queries_without_sql(spark, directory, name):
    """A row for each document, with the contract's columns; the digests of op1 and op4 are those of plain versions."""
    columns = {"op1_pii": ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op2_quality": ["held_out", "score", "predicted"], "op4_bpe": ["n_tokens", "ids_sha256", "decoded_sha256"], "op5_fingerprint": ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "op10_toxicity": ["held_out", "score", "predicted"]}[name]
    docs = rows_of(spark.read.parquet(f"{directory}/documents.parquet"))
    found = __spark_entry__.queries()[name](spark, directory).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in docs) and set(columns) <= set(found[0].__fields__)
    if name == "op1_pii":
        want = [(str(i), hashlib.sha256(pii.spell(pii.base_spans(t or "")).encode()).hexdigest()) for i, t, *_ in docs]
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in found) == sorted(want)
    if name == "op4_bpe":
        library, want = Tokenizer.from_file(vocabulary_path()), []
        for i, t, *_ in docs:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(want)
    if "predicted" in columns:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.5 if name == "op2_quality" else 0.7)) for r in found)
