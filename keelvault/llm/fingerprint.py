"""Document fingerprints: quartile bucket digests of byte triplets (operator 5).

The triplets of bytes within five places of each other are hashed into BUCKETS buckets and counted.  The digest holds, in
hex, a code of the length (logarithmic), the ratios of the quartiles of the counts, and for each bucket the quartile its
count falls into (two bits).  Two digests are compared by a difference score, the sum of the distances of the codes, with a
bound for each part; the likeness is one minus the score's share of its bound.

Distribution: a document is compared with the next one by descending id.  The rows are partitioned by ranges of the id and
sorted; a task reads its range as a stream, so that a text crosses the network once and two texts are held at a time.  The
first and last row of each range are put aside with their texts, and joined across the ranges' seams.

Defined results: a null or empty text has the digest of no triplets and length 0; rows of equal id come in the order of
a hash of their texts (a null as an empty text); rows with a null id come last; a sole row is its own next; two empty texts are
alike (1.0); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import free_name, stored

BUCKETS = 128
_TABLES = [np.random.default_rng(900 + i).permutation(256).astype(np.uint8) & np.uint8(BUCKETS - 1) for i in range(9)]
#: The second and third byte of each kind of triplet, in places after the first.
KINDS = ((1, 2), (1, 3), (2, 4))
#: The most that a length, a ratio and a bucket can add to the difference.
LENGTH_MOST, RATIO_MOST, BUCKET_MOST = 64, 7, 4
#: Two bits of difference: a step of one quartile counts 1, of two 2, of three 4.
STEPS = np.array([0, 1, 2, 4])
#: Differences from this score on are a likeness of 0: unrelated texts of one language are already near half the buckets' bound.
SCORE_MOST = LENGTH_MOST + 2 * RATIO_MOST + BUCKETS * 2
#: Bytes counted at once.
BYTES_AT_ONCE = 1 << 18


def counts(data: bytes) -> np.ndarray:
    """Counts of the triplets of a text by bucket, in bounded memory."""
    b, out = np.frombuffer(data, np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(b), BYTES_AT_ONCE):
        for kind, (j, k) in enumerate(KINDS):
            n = min(BYTES_AT_ONCE, len(b) - k - at)
            if n > 0:
                t = _TABLES[3 * kind : 3 * kind + 3]
                out += np.bincount(t[0][b[at : at + n]] ^ t[1][b[at + j : at + j + n]] ^ t[2][b[at + k : at + k + n]], minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    """Fingerprint of a text in UTF-8: length code, ratios, quartiles of the buckets, in hex."""
    c = counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    length = min(255, int(np.log1p(len(data)) * 8))
    ratios = (15 * q1 // max(q3, 1), 15 * q2 // max(q3, 1))
    quartile = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = (quartile.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


_PAIRS = np.array([[sum(int(STEPS[abs((a >> s & 3) - (b >> s & 3))]) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def difference(a: str, b: str) -> int:
    """The bounded difference score of two fingerprints."""
    length = min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)) * 2)
    ratio = sum(min(RATIO_MOST, abs(int(a[i], 16) - int(b[i], 16))) for i in (2, 3))
    x, y = np.frombuffer(bytes.fromhex(a[4:]), np.uint8), np.frombuffer(bytes.fromhex(b[4:]), np.uint8)
    return length + ratio + int(_PAIRS[x, y].sum())


def likeness(a: str, b: str) -> float:
    return 1.0 - min(SCORE_MOST, difference(a, b)) / SCORE_MOST


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and fingerprint (see free_name)."""
    own, name = docs.columns, free_name(docs, "fingerprint")
    at = own.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*own, name])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own).mapInArrow(work, f"{fields}, `{name}` string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"


def compared(doc_id: int | None, text: str, own: str, following: str, next_digest: str) -> tuple:
    changed = edited(text, following).encode()
    other = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, next_digest)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted partition with the row after it; the first and the last row go out with their texts."""
    part = TaskContext.get().partitionId()
    held: tuple[int | None, str, str] | None = None
    out: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                own = digest(text.encode())
                if held is None:
                    out.append((doc_id, None, None, None, None, None, None, part, "first", text))
                else:
                    out.append((*compared(*held, text, own), part, None, None))
                held = (doc_id, text, own)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
    if held is not None:
        out.append((held[0], None, None, None, None, None, None, part, "last", held[1]))
    yield batch_of(out)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the last row of a partition with the first of the next one."""
    for batch in batches:
        rows = [(*compared(d, t, digest(t.encode()), f, digest(f.encode())), None, None, None) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield batch_of(rows)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # rows of one id are told apart, so that many of them can be split
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_stream, SCHEMA), "fingerprints")
    parts = sorted(r["part"] for r in found.filter("edge = 'first'").select("part").collect())  # a number for each partition
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, following int")
    last = found.filter("edge = 'last'").select("part", "doc_id", "text").join(following, "part")
    first = found.filter("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    seams = last.join(first, "following").select("doc_id", "text", "next_text").mapInArrow(_across, SCHEMA)
    return found.filter("edge IS NULL").unionByName(seams).drop("part", "edge", "text")
