import hashlib
import random

import numpy as np
import xxhash

from keelvault.llm import fingerprint as fp


def test_digests():
    assert fp.likeness(fp.digest(b""), fp.digest(b"")) == 1.0
    r = random.Random(1)
    words = [r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "north"]) + str(r.randrange(50)) for _ in range(600)]
    text = " ".join(words)
    edited = " ".join([*words[:570], *["changed"] * 30])
    other = " ".join("".join(r.choice("qxzjkvw") for _ in range(6)) for _ in range(600))
    own = fp.digest(text.encode())
    assert own == fp.digest(text.encode()) and len(own) == 4 + fp.BUCKETS // 2
    assert 1.0 > fp.likeness(own, fp.digest(edited.encode())) > fp.likeness(own, fp.digest(other.encode())) >= 0.0
    assert fp.difference(own, fp.digest(edited.encode())) == fp.difference(fp.digest(edited.encode()), own)
    long = text.encode() * 200  # counted in several parts
    saved, fp.BYTES_AT_ONCE = fp.BYTES_AT_ONCE, 1 << 30
    whole = fp.counts(long)
    fp.BYTES_AT_ONCE = saved
    assert (fp.counts(long) == whole).all()


def brute(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), np.uint64(xxhash.xxh64_intdigest(x[1].encode(), 42)).view(np.int64)))
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = (t[: len(t) - half] + n[:half]).encode()
        a, b, c = fp.digest(t.encode()), fp.digest(e), fp.digest(n.encode())
        out.append((i, len(t), hashlib.sha256(e).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(map(str, out))


def test_neighbours(make_docs, odd_rows):
    rows = [*odd_rows, *((100 + i, f"text number {i} é " * (i % 13), "s") for i in range(200))]
    docs = make_docs(rows).repartition(5)
    assert sorted(str(tuple(r)) for r in fp.compare_neighbours(docs).collect()) == brute(rows)
    assert sorted(str(tuple(r)) for r in fp.compare_neighbours(make_docs([(1, "alone here")])).collect()) == brute([(1, "alone here")])
    assert fp.compare_neighbours(docs.limit(0)).count() == 0
    assert "fingerprint" in fp.fingerprints(docs).columns


def test_a_column_of_the_callers_stays(make_docs):
    docs = make_docs([(1, "some text")]).withColumnRenamed("row", "fingerprint")
    found = fp.fingerprints(docs)
    assert found.columns == [*docs.columns, "fingerprint_"] and found.first()["fingerprint"] == "r" and found.first()["fingerprint_"] == fp.digest(b"some text")
