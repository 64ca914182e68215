"""Toxicity by class-conditional Kneser-Ney models (operator 10).

Two models, of toxic and of ordinary texts, give each word, after the two words before it, a probability; two more give each
letter of a word, after up to seven bytes of the word before it, a probability, so that forms of one stem help each other.  A
word is a run of letters and digits (any byte from 0x80 on is one), A-Z as a-z.  Both classes are smoothed alike, by interpolated
Kneser-Ney over every sequence of up to ORDERS words (or bytes) of their training texts, however rare.  With c the class, D the
discount, h what comes before w and h' that without its first element,

    P_c(w | h) = max(n_c(h w) - D, 0) / n_c(h .)  +  D * kinds_c(h .) / n_c(h .) * P_c(w | h'),

where n_c counts occurrences for the longest sequences, and for shorter ones continuations: the number of different elements that
stand before the sequence in texts of the class; n_c(h .) is the sum over all that follows h, kinds_c(h .) the number of different
elements that follow it, and a context that the class doesn't know gives P_c(w | h').  Before a text stand two marks of its start.
Before the letters of a word stands a blank, and sequences that begin with it count occurrences.  Below the single elements lies
an even share of all elements of both classes and one unknown one.

A word's log ratio is the difference of its two log-likelihoods, by letters and by words, after none, one and two words before it
(a Kneser-Ney model holds those of all shorter contexts).  A document's features are length-normalised, for each of these four:
the mean log ratio of the whole text, the highest mean of its passages of 1, 4, 16 and 64 words, and the mean of its TOP different
words with the highest ratios; a single word counts for MOST at most, either way.  A logistic curve makes a score of them.

Counts come from every labelled row of the training folds but those that fit the curve: of one fifth of those rows at most
FIT_ROWS, a documented bound.  Words and pairs of words are keyed by 48 bits of hash, a third word before a pair by 40 more, sequences
of bytes by the bytes themselves.

Words: tables and questions meet in parts, which are ranges of the pairs' and the words' keys.  A part counts the sequences of its
pairs once, and sends what they say of their contexts and words to the parts of those.  Of texts, runs of about TASK_KEYS words ask
each part for the pairs, the words before them and the single words that they hold, each once, and get counts back.  So no table
and no text is held whole anywhere.  Letters: each different word of all texts is rated once.  The COMMON most frequent sequences
of letters (16 bytes each) are broadcast; where there are more, the words in question are joined with the whole table
(``spelt_late``), with the same result; a filter of at most 2**FILTER_BITS bits only saves work there.

Folds are taken of the CRC-32 of the id; ids, labels, languages and sources are never inputs of a score.

Defined results: a null or empty text, or one without words, has zero features and so one score for all of them; a null label
isn't learnt from; a row is labelled toxic if any of its labels is; without labels of both classes every score is 0; repeated
rows score alike; extra columns are carried, and where one has the score's name already the score takes a longer one
(``free_name``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._filter import bit_map, parted
from ._store import free_name, release, stored, written
from ._text import _FOLDED, FOLD, mix, powers, text_slices, trimmed, word_hashes, words

#: The pairs of models, and the elements of their longest sequences.
WORDS, LETTERS = "words", "letters"
ORDERS = {WORDS: 3, LETTERS: 8}
DISCOUNT = 0.75
#: Widths of the passages, in words.
PASSAGES = (1, 4, 16, 64)
#: Different words of the highest ratios that are looked at together, and the highest ratio of a word.
TOP, MOST = 3, 6.0
#: By the model of single words, of two, of three, and by that of letters.
FEATURES = [f"_toxicity_f{i}" for i in range((ORDERS[WORDS] + 1) * (len(PASSAGES) + 2))]
#: Text bytes worked on at once: arrays of a task take some forty times as much.
SLICE = 1 << 19
#: The most sequences of letters that are broadcast, and bits of the filter.
COMMON, FILTER_BITS = 1 << 22, 28
#: Words that a task holds before it gives them on; texts in a part of the tables of words.
TASK_KEYS, PART_ROWS = 1 << 18, 4000
#: Words in a part of the table of letters.
PART_WORDS = 50_000
#: Texts are rated one share after the other, so that less of what they ask is on disk at once; there are at most so many shares, of
#: the texts of so many parts at least.
ROUNDS, SHARE_PARTS = 10, 6
#: At most so many rows fit the logistic curve.
FIT_ROWS = 20_000
#: With more labels than this, texts meet them by a shuffle instead of a broadcast.
BROADCAST_LABELS = 2_000_000
#: A document is toxic from this score on.
THRESHOLD = 0.7

#: Bytes that part words: all below 0x80 but letters and digits.
APART = np.zeros(256, bool)
APART[:128] = True
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What travels between tasks: kinds of packed columns, whether the first one rises, and their types.
_U8, _U4, _U1, _F4 = np.uint64, np.uint32, np.uint8, np.float32
PAIRS, TRIPLES, CONTEXTS, SINGLES, SPELT, ASK_PAIRS, ASK_TRIPLES, ASK_WORDS, TEXTS, PLACES, OF_PAIRS, OF_TRIPLES, OF_WORDS, COUNTED, PARTED, KNOWN, SUMS, MET, SPELLING, LEARNT, SPELLED, SEQUENCES, BYTES, FOLLOWED, CONTEXT = range(25)
LAYOUT = {
    COUNTED: (True, [_U8, _U8, _U4]),  # second and first word of a pair, number of its triples
    PARTED: (False, [_U4, _U4, _U8]),  # occurrences by class, pair before
    PAIRS: (True, [_U8, _U4]),  # pair, number of its triples
    TRIPLES: (False, [_U4, _U4, _U8]),  # occurrences by class, upper bits of the pair before
    CONTEXTS: (True, [_U8, *[_U4] * 4]),  # pair, what follows it: occurrences and kinds by class
    KNOWN: (True, [_U8, *[_U4] * 5]),  # pair, number of its triples; what follows it: occurrences and kinds by class
    SUMS: (False, [_U8] * 5),  # of all single words: continuations by class, those that have any by class, and by either
    SINGLES: (True, [_U8, *[_U4] * 6]),  # word, continuations; what follows it: continuations and kinds by class
    MET: (True, [_U8, _U4]),  # word, its bytes
    SPELLING: (False, [_U1]),
    LEARNT: (True, [_U8, _U8, _U8, _U4]),  # word, occurrences by class, its bytes
    SPELLED: (True, [_U8] * 3),  # sequence of letters, occurrences by class
    SEQUENCES: (True, [_U8] * 4),  # the same, occurrences, what the model counts by class
    BYTES: (True, [_U8] * 3),  # single byte, continuations by class
    FOLLOWED: (True, [_U8] * 5),  # context of letters, what follows it by sequences of a part: counts and kinds by class
    CONTEXT: (True, [_U8] * 5),  # the same, by all sequences
    SPELT: (True, [_U8, _F4]),  # word, ratio by its letters
    ASK_PAIRS: (True, [_U8, _U4]),
    ASK_TRIPLES: (False, [_U8]),
    ASK_WORDS: (True, [_U8]),
    TEXTS: (False, [_U8, _U4]),  # key of a text, its words
    PLACES: (False, [_U4]),  # which of the words stands there
    OF_PAIRS: (False, [_U4] * 6),
    OF_TRIPLES: (False, [_U4] * 2),
    OF_WORDS: (True, [_U8, *[_U4] * 6, _F4]),
}
PACKED = "part int, chunk long, kind int, n long, blob binary"


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never used."""
    return fold(doc_id) % 3 == 1


# --- packed columns -------------------------------------------------------------------------------------------------------


def packed(part: int, chunk: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row that holds columns of one length byte by byte, compressed; one that rises by its differences.  Bytes that are 0 in all
    of a column are left out: before the rest stands how many each column has."""
    rising, types = LAYOUT[kind]
    columns = [np.ascontiguousarray(c, t) for c, t in zip(columns, types, strict=True)]
    if rising:
        columns[0] = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    n, blob = len(columns[0]), b""
    if n:
        columns = [c.view(_U4) if c.dtype == _F4 else c for c in columns]
        widths = [max(1, -(-int(c.max()).bit_length() // 8)) for c in columns]
        planes = [c.view(np.uint8)[k :: c.itemsize] for c, w in zip(columns, widths, strict=True) for k in range(w)]
        blob = bytes(widths) + pa.compress(np.concatenate(planes), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["part", "chunk", "kind", "n", "blob"])


def unpacked(kind: int, n: int, blob: bytes) -> list[np.ndarray]:
    rising, types = LAYOUT[kind]
    if not n:
        return [np.zeros(0, t) for t in types]
    widths = blob[: len(types)]
    planes = np.frombuffer(pa.decompress(memoryview(blob)[len(types) :], n * sum(widths), "zstd"), np.uint8).reshape(-1, n)
    at, out = 0, []
    for t, w in zip(types, widths, strict=True):
        column = np.zeros(n, t)
        for k in range(w):
            column.view(np.uint8)[k :: column.itemsize] = planes[at + k]
        out.append(column)
        at += w
    return [np.cumsum(out[0], dtype=types[0]), *out[1:]] if rising else out


class Group:
    """The packed rows of a part or of a run of texts, in the order of part and run."""

    def __init__(self, table: pa.Table) -> None:
        part, chunk, kind = (table[c].to_numpy() for c in ("part", "chunk", "kind"))
        self.table, self.by = table, {}
        for i in np.lexsort((chunk, part)):
            self.by.setdefault(int(kind[i]), []).append(int(i))

    def all(self, kind: int) -> list[np.ndarray]:
        """The columns of all rows of a kind, one after the other."""
        rows = [self.row(kind, i) for i in self.by.get(kind, [])]
        return [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else unpacked(kind, 0, b"")

    def row(self, kind: int, i: int) -> list[np.ndarray]:
        return unpacked(kind, self.table["n"][i].as_py(), self.table["blob"][i].as_py())


def together(batches: list[pa.RecordBatch]) -> pa.Table:
    empty = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
    return pa.Table.from_batches(batches, empty).combine_chunks()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range in which each key of 48 bits lies."""
    return ((keys >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts of rising keys, and which keys are theirs."""
    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), slice(int(cuts[p]), int(cuts[p + 1]))


def ordered(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An order of rows by two keys of 48 bits: one sort by all of the first and the upper bits of the second; ties of unlike ones are sorted again."""
    both = keys << np.uint64(16) | more >> np.uint64(32)
    by = np.argsort(both)
    key, low = both[by], more[by]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    odd = np.flatnonzero(~new[1:] & (low[1:] != low[:-1]))
    if len(odd):
        group = np.cumsum(new) - 1
        again = np.zeros(int(group[-1]) + 1, bool)
        again[group[odd]] = True
        at = np.flatnonzero(again[group])
        by[at] = by[at][np.lexsort((low[at], key[at]))]
    return by


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1 and so on of each run of a size."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their counts."""
    by = np.argsort(keys)
    keys = keys[by]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[begin], *[np.add.reduceat(c[by], begin, dtype=np.int64) if len(begin) else c for c in counts]]


def picked(keys: np.ndarray, asked: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The values of each key asked for, 0 where it isn't there."""
    if not len(keys):
        return [np.zeros(len(asked), c.dtype) for c in columns]
    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[place] == asked
    return [np.where(hit, c[place], c.dtype.type(0)) for c in columns]


def signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


# --- words ----------------------------------------------------------------------------------------------------------------


def pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The key of two words, of 48 bits."""
    return mix(one * _ODD + two + np.uint64(1)) >> np.uint64(16)


#: The mark before a text, as a word and as a pair.
START = np.zeros(1, np.uint64)
STARTS = pair(START, START)


class Run:
    """Words of texts, one after the other: own (keys), doc_first (where texts begin), prior (which place stands before each, the
    number of places for the mark of the start), pairs (keys of each word with the one before it) and before (of the two before
    that).  The mark is one more place at the end of own and pairs."""

    def __init__(self, own: np.ndarray, doc_first: np.ndarray) -> None:
        n, first = len(own), doc_first[:-1][np.diff(doc_first) > 0]
        self.n, self.doc_first, self.own = n, doc_first, np.append(own, START)
        self.prior = np.arange(n) - 1
        self.prior[first] = n
        self.pairs = np.append(pair(self.own[self.prior], own), STARTS)
        self.before = self.pairs[self.prior]

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """An order of all places, that of the mark too, by pair and what stands before, and where new triples begin in it."""
        before = np.append(self.before, START)
        by = ordered(self.pairs, before)
        p, b = self.pairs[by], before[by]
        return by, np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])])


def keyed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 48 bits, starts and ends of the words, and the first word of each text."""
    starts, ends, doc_first = words(data, off, APART)
    return folded_hashes(data, starts, ends) >> np.uint64(16), starts, ends, doc_first


@functools.cache
def inverse() -> np.ndarray:
    """The inverses, modulo 2**64, of the powers of the hash base, for places of a slice."""
    p, base = np.full(SLICE + 1, pow(int(powers(2)[1]), -1, 1 << 64), np.uint64), powers(2)[:1]
    p[0] = base[0]
    return np.multiply.accumulate(p)


def folded_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What ``word_hashes`` with fold gives, from sums over all bytes of a slice; longer texts go there."""
    if len(data) > SLICE or len(data) >= len(inverse()):
        return word_hashes(data, starts, ends, fold=True)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED[data] * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse()[starts] + (ends - starts).astype(np.uint64))


def runs(batches: Iterator[pa.RecordBatch], at: int, *more: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys of words, first word of each text, other columns) of runs of texts of about TASK_KEYS words."""
    held, size = [], 0

    def given() -> tuple[np.ndarray, ...]:
        own, sizes, *others = (np.concatenate(c) for c in zip(*held, strict=True))
        return own, np.concatenate([[0], np.cumsum(sizes)]), *others

    for batch in batches:
        for a, b, data, off in text_slices(batch.column(at), SLICE):
            own, _, _, doc_first = keyed_words(data, off)
            held.append((own, np.diff(doc_first), *[batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in more]))
            size += len(own)
            if size > TASK_KEYS:
                yield given()
                held, size = [], 0
    if held:
        yield given()


def begins(keys: np.ndarray) -> np.ndarray:
    """Where new ones begin among rising keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def sequences(texts: DataFrame, parts: int) -> DataFrame:
    """What each part counts of its pairs, packed, and what that says of others.  texts: text, toxic (boolean)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (own, doc_first, toxic) in enumerate(runs(batches, 0, 1)):
            chunk = (task << 32) + number
            run, of_toxic = Run(own, doc_first), np.append(np.repeat(toxic.astype(bool), np.diff(doc_first)), False)
            by, first = run.triples()
            nt, no = (np.add.reduceat(c[by], first, dtype=np.int64) for c in (of_toxic, ~of_toxic))
            at = by[first]
            real = at < run.n  # not the mark
            at, nt, no = at[real], nt[real], no[real]
            new = begins(run.pairs[at])
            size = np.diff(np.append(new, len(at)))
            for p, s in dealt(run.pairs[at[new]], parts):
                some, first, many = at[new[s]], new[s], size[s]
                rising = np.argsort(run.own[some])
                some, first, many = some[rising], first[rising], many[rising]
                low = spans(first, many)
                yield packed(p, chunk, COUNTED, run.own[some], run.own[run.prior[some]], many)
                yield packed(p, chunk, PARTED, nt[low], no[low], run.before[at[low]])

    def united(group: pa.Table) -> pa.Table:
        held, part = Group(group), group["part"][0].as_py()
        found = []
        for i, j in zip(held.by[COUNTED], held.by[PARTED], strict=True):  # one of each a run
            (two, one, size), (nt, no, before) = held.row(COUNTED, i), held.row(PARTED, j)
            found.append((*(np.repeat(c, size) for c in (pair(one, two), one, two)), before, nt, no))
        key, one, two, before, nt, no = (np.concatenate(c) for c in zip(*found, strict=True))
        by = ordered(key, before)
        key, before = key[by], before[by]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (before[1:] != before[:-1])])
        nt, no = (np.add.reduceat(c[by], first, dtype=np.int64) for c in (nt, no))
        key, before, one, two = key[first], before[first], one[by[first]], two[by[first]]
        new = begins(key)
        ct, co = (np.add.reduceat(c > 0, new, dtype=np.int64) for c in (nt, no))  # continuations of each pair
        out = [packed(part, 0, PAIRS, key[new], np.diff(np.append(new, len(key)))), packed(part, 0, TRIPLES, nt, no, before >> np.uint64(8))]
        context = summed(before, nt, no, nt > 0, no > 0)
        out += [packed(p, 0, CONTEXTS, *[c[s] for c in context]) for p, s in dealt(context[0], parts)]
        none = np.zeros(len(new), np.int64)
        single = summed(np.concatenate([two[new], one[new]]), *(np.concatenate(c) for c in ((ct > 0, none), (co > 0, none), (none, ct), (none, co), (none, ct > 0), (none, co > 0))))
        return together([*out, *[packed(p, 0, SINGLES, *[c[s] for c in single]) for p, s in dealt(single[0], parts)]])

    blobs = texts.mapInArrow(trimmed(counted), PACKED)
    return blobs.groupBy("part").applyInArrow(united, PACKED)


def united_parts(group: pa.Table) -> pa.Table:
    """A part's table, from what all parts say: a row of its pairs (those that only occur as contexts too), their triples, its words and the sums over those."""
    held, part = Group(group), group["part"][0].as_py()
    (key, size), triples = held.all(PAIRS), held.all(TRIPLES)
    context, single = summed(*held.all(CONTEXTS)), summed(*held.all(SINGLES))
    every = np.sort(np.concatenate([key, context[0]]))
    every = every[begins(every)]
    _, ct, co, *_ = single
    sums = [ct.sum(), co.sum(), (ct > 0).sum(), (co > 0).sum(), ((ct > 0) | (co > 0)).sum()]
    return together([packed(part, 0, KNOWN, every, *picked(key, every, size), *picked(context[0], every, *context[1:])), packed(part, 0, TRIPLES, *triples), packed(part, 0, SINGLES, *single), packed(part, 0, SUMS, *[np.array([v]) for v in sums])])


class Sequences:
    """The tables of words: packed rows, the number of parts, and by class the continuations of all words and the number of words
    that have any; and that of the words of both classes."""

    def __init__(self, rows: DataFrame, parts: int) -> None:
        names = ["nt", "no", "vt", "vo", "v"]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = Group(pa.Table.from_batches([batch])).all(SUMS)
                yield pa.RecordBatch.from_arrays([signed(c) for c in found], names=names)

        self.rows, self.parts = rows.filter(F.col("kind") != SUMS), parts
        found = rows.filter(F.col("kind") == SUMS).mapInArrow(sums, ", ".join(f"{c} long" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
        self.totals, self.kinds, self.all = (found["nt"], found["no"]), (found["vt"], found["vo"]), found["v"] + 1


def asked(docs: DataFrame, parts: int) -> DataFrame:
    """What runs of texts ask of each part, packed, and the runs themselves.  docs: of (key of the text), text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (own, doc_first, of) in enumerate(runs(batches, 1, 0)):
            run, chunk = Run(own, doc_first), (task << 32) + number
            keys, which = np.unique(run.own, return_inverse=True)
            yield packed(parts + chunk % parts, chunk, TEXTS, of.view(np.uint64), np.diff(doc_first))
            yield packed(parts + chunk % parts, chunk, PLACES, which[: run.n])
            for p, s in dealt(keys, parts):
                yield packed(p, chunk, ASK_WORDS, keys[s])
            by, first = run.triples()
            key, before = run.pairs[by[first]], np.append(run.before, START)[by[first]] >> np.uint64(8)
            new = begins(key)
            size = np.diff(np.append(new, len(key)))
            for p, s in dealt(key[new], parts):
                yield packed(p, chunk, ASK_PAIRS, key[new[s]], size[s])
                yield packed(p, chunk, ASK_TRIPLES, before[new[s][0] : new[s][-1] + size[s][-1]])

    return docs.select("of", "text").mapInArrow(trimmed(work), PACKED)


def answered(group: pa.Table) -> pa.Table:
    """A part's answers; the runs of texts go on as they are."""
    held, out = Group(group), []
    if TEXTS in held.by:
        return group
    (key, size, *context), (nt, no, before) = held.all(KNOWN), held.all(TRIPLES)
    end = np.cumsum(size, dtype=np.int64)
    ct, co = (np.diff(np.concatenate([[0], np.cumsum(c > 0)])[np.append(0, end)]).astype(np.uint32) for c in (nt, no))
    triple = np.repeat(np.arange(len(key), dtype=np.uint64), size) << np.uint64(40) | before
    single = held.all(SINGLES)
    word, ratio = held.all(SPELT)
    by = np.argsort(word)
    word, ratio = word[by], ratio[by]
    part, chunk = group["part"][0].as_py(), group["chunk"].to_numpy()
    for i in held.by.get(ASK_WORDS, []):
        (own,) = held.row(ASK_WORDS, i)
        out.append(packed(part, int(chunk[i]), OF_WORDS, own, *picked(single[0], own, *single[1:]), *picked(word, own, ratio)))
    for i, j in zip(held.by.get(ASK_PAIRS, []), held.by.get(ASK_TRIPLES, []), strict=True):
        (own, sizes), (back,) = held.row(ASK_PAIRS, i), held.row(ASK_TRIPLES, j)
        (place,) = picked(key, own, np.arange(1, len(key) + 1))
        there = np.flatnonzero(place)
        place, values = place[there] - 1, np.zeros((6, len(own)), np.uint32)
        for v, c in zip(values, (ct, co, *context), strict=True):
            v[there] = c[place]
        out.append(packed(part, int(chunk[i]), OF_PAIRS, *values))
        at = spans((np.cumsum(sizes, dtype=np.int64) - sizes)[there], sizes[there].astype(np.int64))  # triples of pairs that are known
        values = np.zeros((2, len(back)), np.uint32)
        values[:, at] = picked(triple, np.repeat(place.astype(np.uint64), sizes[there]) << np.uint64(40) | back[at], nt, no)
        out.append(packed(part, int(chunk[i]), OF_TRIPLES, *values))
    return together(out)


def log_ratios(run: Run, of_words: list[np.ndarray], of_pairs: list[np.ndarray], of_triples: list[np.ndarray], model: tuple) -> list[np.ndarray]:
    """The log ratio of each place after none, one and two words before it, from the counts of its word, pair and triple, which also have a row for the mark of the start."""
    totals, kinds, elements = model
    likely: list[list[np.ndarray]] = [[], []]
    for c in (0, 1):
        p = (np.maximum(of_words[c][: run.n] - DISCOUNT, 0) + DISCOUNT * kinds[c] / elements) / max(totals[c], 1)
        likely[c].append(np.maximum(p, 1e-300))
        for n, (whole, many) in ((of_pairs[c], (of_words[2 + c], of_words[4 + c])), (of_triples[c], (of_pairs[2 + c], of_pairs[4 + c]))):
            at = np.flatnonzero(whole[run.prior])  # a context that the class doesn't know leaves it as it is
            before = run.prior[at]
            p = p.copy()
            p[at] = (np.maximum(n[at] - DISCOUNT, 0) + DISCOUNT * many[before] * p[at]) / whole[before]
            likely[c].append(np.maximum(p, 1e-300))
    return [np.log(t / o) for t, o in zip(*likely, strict=True)]


def rated_runs(answers: DataFrame, model: tuple) -> DataFrame:
    """of, FEATURES: a row for each text."""

    def work(group: pa.Table) -> pa.Table:
        held = Group(group)
        (of, sizes), (place,) = held.all(TEXTS), held.all(PLACES)
        keys, *of_words, spelt = held.all(OF_WORDS)
        run = Run(keys[place], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        of_words = [c[np.append(place, 0)] for c in of_words]  # the mark's key, 0, is the lowest
        by, first = run.triples()
        new = np.zeros(len(by), bool)
        new[first] = True
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        of_triples = [c[which] for c in held.all(OF_TRIPLES)]
        which[by] = np.cumsum(np.r_[True, np.diff(run.pairs[by]) != 0]) - 1
        of_pairs = [c[which] for c in held.all(OF_PAIRS)]
        ratios = log_ratios(run, of_words, of_pairs, of_triples, model)
        made = np.column_stack([features(x, run.doc_first, run.own[: run.n]) for x in (*ratios, spelt[place])])
        return pa.table([signed(of), *[pa.array(f) for f in made.T]], names=["of", *FEATURES])

    return answers.groupBy("chunk").applyInArrow(work, "of long, " + ", ".join(f"{n} double" for n in FEATURES))


# --- letters --------------------------------------------------------------------------------------------------------------


class Found:
    """Sequences of letters: keys[k] of those of k + 1 that end at each place, there[k] whether there is one."""

    def __init__(self, keys: list[np.ndarray], there: list[np.ndarray]) -> None:
        self.keys, self.there = keys, there

    def candidates(self, k: int, shorter: np.ndarray | None) -> np.ndarray:
        """Where a sequence of k + 1 elements may be known, given the places of those of k: its end and its start must be."""
        if shorter is None:
            return self.there[k]
        out = self.there[k] & shorter
        out[1:] &= shorter[:-1]
        return out

    def marked(self, at: np.ndarray) -> np.ndarray:
        """The places, and those that hold the blank before a word, as a mask."""
        out = ~self.there[0]
        out[at] = True
        return out


def in_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Found, np.ndarray]:
    """Of words with a blank on either side; and the word of each place.

    A sequence is a number of its bytes, the last one lowest.  NUL becomes 0xFF, which UTF-8 never has; so no two sequences of
    any length share a number.
    """
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(starts)), sizes)
    local = np.arange(int(sizes.sum())) - first[owner]
    inner = (local > 0) & (local < sizes[owner] - 1)
    flat = np.full(len(local), 32, np.uint64)
    flat[inner] = FOLD[data[(starts[owner] + local - 1)[inner]]]
    flat[flat == 0] = 255
    keys, there = [flat], [local > 0]  # the blank before a word is a context only
    for k in range(1, ORDERS[LETTERS]):
        key = keys[-1].copy()
        key[k:] |= flat[: max(len(flat) - k, 0)] << np.uint64(8 * k)
        keys.append(key)
        there.append(local >= k)
    return Found(keys, there), owner


def spelling(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some words, one after the other."""
    return data[spans(starts, sizes)]


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def vocabulary(texts: DataFrame, parts: int) -> DataFrame:
    """word (its key), bytes (A-Z as a-z), toxic, ordinary: the occurrences by class of each different word, by way of its part.
    texts: text, toxic (boolean)."""

    def met(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Distinct words, their occurrences by class, their sizes and their bytes, of several such."""
        keys, nt, no, sizes, data = (np.concatenate(c) for c in zip(*found, strict=True))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        by = np.argsort(keys)
        new = begins(keys[by])
        first = by[new]
        nt, no = (np.add.reduceat(c[by], new, dtype=np.int64) if len(new) else c for c in (nt, no))
        sizes = sizes[first].astype(np.int64)
        return keys[first], nt, no, sizes, spelling(data, starts[first], sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        task, number = TaskContext.get().partitionId() << 32, 0

        def given() -> Iterator[pa.RecordBatch]:
            keys, nt, no, sizes, data = held[0]
            starts = np.cumsum(sizes) - sizes
            for p, s in dealt(keys, parts):
                yield packed(p, task + number, LEARNT, keys[s], nt[s], no[s], sizes[s])
                yield packed(p, task + number, SPELLING, spelling(data, starts[s], sizes[s]))

        for batch in batches:
            for a, b, data, off in text_slices(batch.column(0), SLICE):
                data = FOLD[data]
                own, starts, ends, doc_first = keyed_words(data, off)
                toxic = np.repeat(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool), np.diff(doc_first))
                by = np.argsort(own)
                new = begins(own[by])
                first = by[new]
                nt = np.add.reduceat(toxic[by], new, dtype=np.int64) if len(new) else np.zeros(0, np.int64)
                sizes = (ends - starts)[first]
                held.append((own[first], nt, np.diff(np.append(new, len(by))) - nt, sizes, spelling(data, starts[first], sizes)))
            if sum(len(h[0]) for h in held) > 2 * TASK_KEYS:
                held = [met(held)]
                if len(held[0][0]) > TASK_KEYS:
                    yield from given()
                    held, number = [], number + 1
        if held:
            held = [met(held)]
            yield from given()

    def united(group: pa.Table) -> pa.Table:
        held = Group(group)
        found = [(*held.row(LEARNT, i), *held.row(SPELLING, j)) for i, j in zip(held.by[LEARNT], held.by[SPELLING], strict=True)]
        keys, nt, no, sizes, data = met(found)
        return pa.table([signed(keys), binary(data, sizes), pa.array(nt), pa.array(no)], names=["word", "bytes", "toxic", "ordinary"])

    return texts.mapInArrow(trimmed(work), PACKED).groupBy("part").applyInArrow(united, "word long, bytes binary, toxic long, ordinary long")


def all_words(texts: DataFrame, parts: int) -> DataFrame:
    """word (its key) and bytes (A-Z as a-z) of each different word, by way of its part.  texts: text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(TASK_KEYS, np.uint64)  # a word met in each place, so that a task gives most words once
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        task, number = TaskContext.get().partitionId() << 32, 0

        def given() -> Iterator[pa.RecordBatch]:
            keys, sizes, data = (np.concatenate(c) for c in zip(*held, strict=True))
            starts, by = np.cumsum(sizes) - sizes, np.argsort(keys)
            keys, starts, sizes = keys[by], starts[by], sizes[by]
            for p, s in dealt(keys, parts):
                yield packed(p, task + number, MET, keys[s], sizes[s])
                yield packed(p, task + number, SPELLING, spelling(data, starts[s], sizes[s]))

        for batch in batches:
            for _, _, data, off in text_slices(batch.column(0), SLICE):
                data = FOLD[data]
                own, starts, ends, _ = keyed_words(data, off)
                first = np.flatnonzero(met[own % np.uint64(TASK_KEYS)] != own)  # of those that share a place several may stay
                keys, which = np.unique(own[first], return_index=True)
                first = first[which]
                met[keys % np.uint64(TASK_KEYS)] = keys
                sizes = (ends - starts)[first]
                held.append((keys, sizes, spelling(data, starts[first], sizes)))
            if sum(len(h[0]) for h in held) > TASK_KEYS:
                yield from given()
                held, number = [], number + 1
        if held:
            yield from given()

    def united(group: pa.Table) -> pa.Table:
        held = Group(group)
        (keys, sizes), (data,) = (map(np.concatenate, zip(*(held.row(kind, i) for i in held.by[kind]), strict=True)) for kind in (MET, SPELLING))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        keys, first = np.unique(keys, return_index=True)
        sizes = sizes[first].astype(np.int64)
        return pa.table([signed(keys), binary(spelling(data, starts[first], sizes), sizes)], names=["word", "bytes"])

    return texts.mapInArrow(trimmed(work), PACKED).groupBy("part").applyInArrow(united, "word long, bytes binary")


def ending_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of sequences of letters: those that end alike by two bytes meet in one."""
    return (mix(keys & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)


def dealt_ends(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of rising sequences of letters, and the places of theirs, rising too."""
    part = ending_part(keys, parts)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), by[cuts[p] : cuts[p + 1]]


def letters_of(keys: np.ndarray) -> np.ndarray:
    """How many bytes each sequence has."""
    return 1 + sum((keys >= np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, ORDERS[LETTERS]))


def spelt_counts(vocabulary: DataFrame, parts: int) -> DataFrame:
    """What each part counts of its sequences of letters, packed, and what that says of contexts and of single bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        task, number = TaskContext.get().partitionId() << 32, 0

        def given() -> Iterator[pa.RecordBatch]:
            for p, at in dealt_ends(held[0][0], parts):
                yield packed(p, task + number, SPELLED, *[c[at] for c in held[0]])

        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1), SLICE // 4):
                found, owner = in_letters(data, off[:-1], off[1:])
                counts = [batch.column(i).slice(a, b - a).to_numpy()[owner] for i in (2, 3)]
                for keys, there in zip(found.keys, found.there, strict=True):
                    held.append(summed(keys[there], *(c[there] for c in counts)))
                if sum(len(h[0]) for h in held) > 4 * TASK_KEYS:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > 2 * TASK_KEYS:
                        yield from given()
                        held, number = [], number + 1
        if held:
            held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
            yield from given()

    def united(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        keys, *raw = summed(*Group(group).all(SPELLED))
        size, order = letters_of(keys), ORDERS[LETTERS]
        lower = keys & ((np.uint64(1) << (8 * (size - 1)).astype(np.uint64)) - np.uint64(1))
        more = size > 2  # what such a one continues ends alike, so it is here
        kinds = summed(lower[more], *[c[more] > 0 for c in raw])
        whole = (size == order) | ((size > 1) & (keys >> (8 * (size - 1)).astype(np.uint64) == np.uint64(32)))  # from the blank before a word on
        counts = [np.where(whole, c, k) for c, k in zip(raw, picked(kinds[0], keys, *kinds[1:]), strict=True)]
        some = size > 1
        context = summed(keys[some] >> np.uint64(8), *[c[some] for c in counts], *[c[some] > 0 for c in counts])
        two = size == 2
        out = [packed(part, part, SEQUENCES, keys, raw[0] + raw[1], *counts), packed(part, part, BYTES, *summed(lower[two], *[c[two] > 0 for c in raw]))]
        return together([*out, *[packed(p, part, FOLLOWED, *[c[at] for c in context]) for p, at in dealt_ends(context[0], parts)]])

    blobs = vocabulary.select("word", "bytes", "toxic", "ordinary").mapInArrow(trimmed(work), PACKED)
    return blobs.groupBy("part").applyInArrow(united, PACKED)


def followed(group: pa.Table) -> pa.Table:
    """What follows the contexts of a part, for the part itself and for each part that has sequences with them."""
    held, part = Group(group), group["part"][0].as_py()
    keys, *sums = summed(*held.all(FOLLOWED))
    out, chunk = [packed(part, part, CONTEXT, keys, *sums)], group["chunk"].to_numpy()
    for i in held.by[FOLLOWED]:
        asked, *_ = held.row(FOLLOWED, i)
        out.append(packed(int(chunk[i]), part, FOLLOWED, asked, *picked(keys, asked, *sums)))
    return together(out)


def likelihood(count: np.ndarray, h: np.ndarray, kinds: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Kneser-Ney's, given the shorter sequence's."""
    return np.where(h > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * under) / np.maximum(h, 1), under)


def left_over(h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The log of what a context leaves to shorter ones."""
    return np.log(np.maximum(np.where(h > 0, DISCOUNT * kinds / np.maximum(h, 1), 1.0), 1e-300))


def spelt_model(vocabulary: DataFrame) -> DataFrame:
    """key, n, ratio, rest: of each sequence of letters its occurrences, its log ratio, and the log ratio of what it leaves, as
    a context, to shorter ones.  Under key 0 stands the ratio of elements that no text has.

    Sequences meet in parts by their ends, where all that they continue are too; what follows a context is summed in the part of
    the context and goes back to those that have sequences with it.
    """
    spark, schema = vocabulary.sparkSession, "key long, n long, ratio float, rest float"
    parts = max(spark.sparkContext.defaultParallelism, -(-vocabulary.count() // PART_WORDS))
    table = stored(spelt_counts(vocabulary, parts), "toxic-letters")
    answers = stored(table.filter(F.col("kind") == FOLLOWED).groupBy("part").applyInArrow(followed, PACKED), "toxic-letter-contexts")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Group(pa.Table.from_batches([batch])).all(BYTES)
            yield pa.RecordBatch.from_arrays([signed(c) for c in found], names=["key", "toxic", "ordinary"])

    found = table.filter(F.col("kind") == BYTES).mapInArrow(single, "key long, toxic long, ordinary long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()  # at most 256 rows
    if not found.num_rows:
        return spark.createDataFrame([], schema)
    counts = [np.zeros(256, np.int64) for _ in range(2)]
    for c, name in zip(counts, ("toxic", "ordinary"), strict=True):
        c[found["key"].to_numpy()] = found[name].to_numpy()
    h, kinds, even = [c.sum() for c in counts], [(c > 0).sum() for c in counts], 1 / (found.num_rows + 1)
    bytes_ = [likelihood(c, x, k, np.full(256, even)) for c, x, k in zip(counts, h, kinds, strict=True)]
    outside = float(np.float32(left_over(h[0], kinds[0]) - left_over(h[1], kinds[1])))

    def work(group: pa.Table) -> pa.Table:
        held = Group(group)
        keys, n, *counts = held.all(SEQUENCES)
        context = held.all(FOLLOWED)
        by = np.argsort(context[0])
        of = picked(context[0][by], keys >> np.uint64(8), *[c[by] for c in context[1:]])
        size, likely = letters_of(keys), [b[keys & np.uint64(255)] for b in bytes_]
        cuts = np.searchsorted(size, np.arange(ORDERS[LETTERS] + 2))  # longer ones are larger numbers
        for k in range(2, ORDERS[LETTERS] + 1):
            here, shorter = slice(cuts[k], cuts[k + 1]), slice(cuts[k - 1], cuts[k])
            lower = keys[here] & np.uint64((1 << 8 * (k - 1)) - 1)
            at = np.searchsorted(keys[shorter], lower) if k > 2 else None
            for c in (0, 1):
                under = bytes_[c][lower] if at is None else likely[c][shorter][at]
                likely[c][here] = likelihood(counts[c][here], of[c][here], of[2 + c][here], under)
        ratio = np.log(np.maximum(likely[0], 1e-300)) - np.log(np.maximum(likely[1], 1e-300))
        own = held.all(CONTEXT)
        rest = picked(own[0], keys, *own[1:])
        rest = left_over(rest[0], rest[2]) - left_over(rest[1], rest[3])
        return pa.table([signed(keys), signed(n), pa.array(ratio.astype(np.float32)), pa.array(rest.astype(np.float32))], names=["key", "n", "ratio", "rest"])

    every = table.filter(F.col("kind") == SEQUENCES).unionByName(answers).groupBy("part").applyInArrow(work, schema).filter("key <> 0")
    none = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(outside).cast("float").alias("ratio"), F.lit(0.0).cast("float").alias("rest"))
    return stored(every.unionByName(none), "toxic-table")


def kneser_ney(kind: str, toxic: DataFrame, ordinary: DataFrame, documents: DataFrame):  # noqa: ANN201
    """The pair of models of a kind: Sequences of words, or the table of letters.

    toxic, ordinary, documents: tables with a column text; there are as many parts as documents need.
    """
    texts = toxic.select("text", F.lit(True).alias("toxic")).unionByName(ordinary.select("text", F.lit(False).alias("toxic")))
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, -(-documents.count() // PART_ROWS))
    if kind == LETTERS:
        since = written()
        table = spelt_model(stored(vocabulary(texts, parts), "toxic-vocabulary"))
        release(since, keep=1)
        return table
    since = written()
    counted = stored(sequences(texts, parts), "toxic-counted")
    halves = [counted.filter(F.col("part") % 2 == i) for i in range(2)]  # one after the other, so that less is on disk at once
    rows = [stored(h.groupBy("part").applyInArrow(united_parts, PACKED), "toxic-sequences") for h in halves]
    release(since, keep=len(rows))
    return Sequences(functools.reduce(DataFrame.unionByName, rows), parts)


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A bit map of the keys, two bits each; its size follows their number up to 2**FILTER_BITS bits."""
    bits = min(FILTER_BITS, max(16, (12 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate(in_filter(batch.column(0).to_numpy().view(np.uint64), bits))
            word, which = np.unique(p >> np.uint64(6), return_inverse=True)
            b = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(b, which, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([signed(word), signed(b)], names=["w", "b"])

    found = keys.select("key").mapInArrow(places, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def in_filter(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    h = mix(keys)
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def may_be(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key may be in the map: never wrong for one that is."""
    one, two = ((table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) for p in in_filter(keys, len(table).bit_length() - 1 + 6))
    return (one & two & np.uint64(1)).astype(bool)


class Keys:
    """Keys in the order of a scramble, with the place where each range of it begins, and columns that go with them."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.n, hashes = len(keys), mix(keys)
        by = np.argsort(hashes)
        self.columns = [c[by] for c in columns]
        self.hashes = np.append(hashes[by], ~np.uint64(0))
        self.bits = max(8, len(keys).bit_length())
        self.begin: np.ndarray | None = None  # made where it is used
        self.longest = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't held."""
        shift = np.uint64(64 - self.bits)
        if self.begin is None:
            self.begin = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << shift).astype(np.int32)
            self.longest = int(np.diff(np.append(self.begin, self.n)).max())
        hashes = mix(keys)
        out, at = np.full(len(keys), -1, np.int64), self.begin[hashes >> shift].astype(np.int64)
        live = np.arange(len(keys))
        for _ in range(self.longest):
            own = self.hashes[at]
            hit = own == hashes
            out[live[hit]] = at[hit]
            on = own < hashes
            live, hashes, at = live[on], hashes[on], at[on] + 1
            if not len(live):
                break
        return np.where(out < self.n, out, -1)


class Lookup:
    """Broadcast of a table of letters: the most frequent sequences, the ratio of other elements, and, where there are more, the
    filter that tells which sequences may be known."""

    def __init__(self, table: DataFrame) -> None:
        none = table.filter("key = 0").first()
        self.outside = none["ratio"] if none else 0.0
        own = table.filter("key <> 0")
        self.total = own.count()
        self.whole = self.total <= COMMON
        found = (own if self.whole else own.orderBy(F.desc("n"), "key").limit(COMMON)).select("key", "ratio", "rest").toArrow()
        self.filter = None if self.whole else key_filter(own, self.total)
        columns = [found["key"].to_numpy().view(np.uint64), found["ratio"].to_numpy(), found["rest"].to_numpy()]
        del found  # the driver holds the table once
        pa.default_memory_pool().release_unused()
        self.held = Keys(*columns)

    def values(self, found: Found) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By size: (ratio or NaN, rest or 0, whether only the whole table knows) of each place."""
        ratios, rests, opens, may = [], [], [], None
        for k, keys in enumerate(found.keys):
            ratio, rest, open_ = np.full(len(keys), np.nan, np.float32), np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
            at = np.flatnonzero(found.candidates(k, may))
            if not self.whole:
                at = at[may_be(self.filter, keys[at])]
            place = self.held.find(keys[at])
            hit = place >= 0
            ratio[at[hit]], rest[at[hit]] = (c[place[hit]] for c in self.held.columns)
            if not self.whole:
                open_[at[~hit]] = True
            may = found.marked(at[hit] if self.whole else at)
            ratios.append(ratio)
            rests.append(rest)
            opens.append(open_)
        return ratios, rests, opens


def joined(ratios: list[np.ndarray], rests: list[np.ndarray], outside: float) -> np.ndarray:
    """The log ratio of each place, from the values of the sequences that end there and of the contexts before it.

    rests of places that nothing follows must be 0.
    """
    out = np.where(np.isnan(ratios[0]), np.float32(outside), ratios[0])
    for k in range(1, len(ratios)):
        before = np.zeros(len(out), np.float32)
        before[1:] = rests[k - 1][:-1]
        out = np.where(np.isnan(ratios[k]), out + before, ratios[k])
    return out


def spelt(look: Lookup, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ratio of each of some words by its letters; NaN where only the whole table knows."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.float32)
    found, owner = in_letters(data, starts, ends)
    ratios, rests, opens = look.values(found)
    last = np.r_[np.flatnonzero(np.diff(owner)), len(owner) - 1]
    for r in rests:
        r[last] = 0
    # the blank before a word is a context that nothing predicts
    blank = look.held.find(np.array([32], np.uint64))[0]
    if blank >= 0:
        rests[0][~found.there[0]] = look.held.columns[1][blank]
    elif not look.whole:
        opens[0] |= ~found.there[0]
    value = joined(ratios, rests, look.outside)
    value[~found.there[0]] = 0
    lacks = np.logical_or.reduce(opens)
    out = np.bincount(owner, value, n).astype(np.float32)
    out[np.unique(owner[lacks])] = np.nan
    return out


def top_words(by_word: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, by its number of words: the mean of its TOP different words with the highest ratios, and how many it has."""
    total, many = np.zeros(len(size)), np.zeros(len(size), int)
    full, owner, rest = np.flatnonzero(size), np.repeat(np.arange(len(size)), size), by_word.copy()
    first = (np.cumsum(size) - size)[full]
    for _ in range(TOP if len(full) else 0):
        high = np.full(len(size), -np.inf)
        high[full] = np.maximum.reduceat(rest, first)
        best = np.flatnonzero((rest == high[owner]) & np.isfinite(rest))
        total += np.where(np.isfinite(high), high, 0) / TOP
        many += np.isfinite(high)
        word = np.full(len(size), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(word, owner[best], hashes[best])  # of equal ones the smallest hash
        rest[hashes == word[owner]] = -np.inf
    return total, many


def features(by_word: np.ndarray, doc_first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A row per document: the highest mean ratio of a passage, by width, the mean over the text, and that of its TOP words."""
    out = np.zeros((len(doc_first) - 1, len(PASSAGES) + 2))
    if not len(by_word):
        return out
    by_word = np.clip(by_word.astype(float), -MOST, MOST)
    sums = np.concatenate([[0.0], np.cumsum(by_word)])
    n, size = len(by_word), np.diff(doc_first)
    full = np.flatnonzero(size)
    first, last = doc_first[full], doc_first[full + 1]
    for i, width in enumerate(PASSAGES):
        mean = np.empty(n)
        mean[: max(n - width + 1, 0)] = sums[width:] - sums[: max(n - width + 1, 0)]
        tail = np.minimum(width - 1, size[full])  # passages that the text's end cuts
        at = spans(last - tail, tail)
        mean[at] = sums[np.repeat(last, tail)] - sums[at]
        out[full, i] = np.maximum.reduceat(mean, first) / width
    out[full, -2] = (sums[last] - sums[first]) / size[full]
    # the words above a limit that about a tenth of them pass have the highest ones of most texts; the others are looked through whole
    high, owner = by_word >= np.quantile(by_word[::16], 0.9), np.repeat(np.arange(len(size)), size)
    out[:, -1], many = top_words(by_word[high], np.bincount(owner[high], minlength=len(size)), hashes[high])
    lacks = many < TOP
    again = lacks[owner]
    out[lacks, -1] = top_words(by_word[again], size[lacks], hashes[again])[0]
    return out


def spelt_words(found: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """The ratio of each word by its letters, packed by parts.  found: word, bytes."""
    look = Lookup(table)
    shared, whole = found.sparkSession.sparkContext.broadcast(look), look.whole
    del look

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1), SLICE // 4):
                ratio = spelt(shared.value, data, off[:-1], off[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ratio, mask=np.isnan(ratio))], names=["word", "ratio"])

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]  # 12 bytes a word
        if held:
            keys, ratio = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.argsort(keys)
            keys, ratio = keys[by], ratio[by]
            for p, s in dealt(keys, parts):
                yield packed(p, 0, SPELT, keys[s], ratio[s])

    if whole:
        done = stored(found.mapInArrow(trimmed(lambda batches: parcels(direct(batches))), PACKED), "toxic-spelling")
    else:
        rows = stored(found.mapInArrow(trimmed(direct), "word long, ratio float"), "toxic-spelt")
        lacks = found.join(rows.filter("ratio IS NULL").select("word"), "word")
        rows = rows.filter("ratio IS NOT NULL").unionByName(spelt_late(lacks, table, shared))
        done = stored(rows.mapInArrow(trimmed(parcels), PACKED), "toxic-spelling")
    shared.destroy()  # each executor has a copy on disk
    return done


def spelt_late(found: DataFrame, table: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """word, ratio: of words of which some sequence of letters is known to the whole table only."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every sequence of a word that may be an expression: its place and size."""
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1), SLICE):
                found, owner = in_letters(data, off[:-1], off[1:])
                word = batch.column(0).slice(a, b - a).to_numpy()
                local = np.arange(len(owner)) - np.searchsorted(owner, owner)
                for k, (keys, there) in enumerate(zip(found.keys, found.there, strict=True)):
                    at = np.flatnonzero(there | (k == 0))
                    at = at[may_be(shared.value.filter, keys[at])]
                    yield pa.RecordBatch.from_arrays([pa.array(word[owner[at]]), pa.array(local[at]), pa.array(np.full(len(at), k, np.int32)), signed(keys[at])], names=["word", "place", "level", "key"])

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, order = shared.value.outside, ORDERS[LETTERS]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = r["size"] + 2
                values = np.concatenate([np.full((order, n), np.nan, np.float32), np.zeros((order, n), np.float32)])
                for v in r["found"]:
                    values[v["level"], v["place"]], values[v["level"] + order, v["place"]] = v["ratio"], v["rest"]
                values[order:, -1] = 0
                out.append(float(joined(list(values[:order]), list(values[order:]), outside)[1:].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float32())], names=["word", "ratio"])

    found = stored(found, "toxic-late-words")
    values = found.mapInArrow(trimmed(spelled), "word long, place long, level int, key long").join(table.select("key", "ratio", "rest"), "key")
    by_word = values.groupBy("word").agg(F.collect_list(F.struct("place", "level", "ratio", "rest")).alias("found"))  # as many as a word has letters
    rows = found.select("word", F.octet_length("bytes").alias("size")).join(by_word, "word", "left").select("word", "size", F.coalesce("found", F.array()).alias("found"))
    return rows.mapInArrow(summed_up, "word long, ratio float")


# --- texts ----------------------------------------------------------------------------------------------------------------


def text_key() -> Column:
    return F.xxhash64("doc_id", "text")


def shares(docs: DataFrame, n: int) -> list[Column]:
    """Conditions of n shares of the rows, of which each row meets one: by ranges of whole-numbered ids, so that a share reads those
    row groups alone that have any of them, by hash of other ids."""
    own = F.col("doc_id")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return [F.pmod(F.xxhash64(own), F.lit(n)) == i for i in range(n)]
    cuts = docs.agg(F.percentile_approx(own, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))  # none of an empty table
    if not cuts:
        return [F.lit(True)]
    return [own.isNull() | (own < cuts[0]), *[(own >= a) & (own < b) for a, b in zip(cuts, cuts[1:], strict=False)], own >= cuts[-1]]


def measured(docs: DataFrame, tables: dict) -> DataFrame:
    """of (key of the text), FEATURES: a row for each different row of id and text."""
    own: Sequences = tables[WORDS]
    since = written()
    letters = spelt_words(stored(all_words(docs.select("text"), own.parts), "toxic-all-words"), tables[LETTERS], own.parts)
    release(since, keep=1)
    known = own.rows.unionByName(letters)
    rounds, found = min(ROUNDS, max(1, -(-docs.count() // (SHARE_PARTS * PART_ROWS)))), []
    for share in shares(docs, rounds):
        some = docs.filter(share).select(text_key().alias("of"), "text")
        answers = known.unionByName(asked(some, own.parts)).groupBy("part").applyInArrow(answered, PACKED)
        found.append(stored(rated_runs(answers, (own.totals, own.kinds, own.all)).dropDuplicates(["of"]), "toxic-features"))
    release(since, keep=len(found))
    return functools.reduce(DataFrame.unionByName, found)


def rated(docs: DataFrame, tables: dict) -> DataFrame:
    """All columns of ``docs`` and FEATURES."""
    key = free_name(docs, "_key")
    return docs.withColumn(key, text_key()).join(measured(docs, tables).withColumnRenamed("of", key), key).select(*docs.columns, *FEATURES)


# --- the curve ------------------------------------------------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), mean and scale of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
    return w, mean, scale


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, from the labelled rows of the training folds; None if they lack a class."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = stored(known, "toxic-labels")
    few = known.count() <= BROADCAST_LABELS
    fits = (F.floor(fold(F.col("doc_id")) / 3) % 5) == 0
    chosen = stored(known.filter(fits).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "toxic-fit")
    learnt = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")  # at most FIT_ROWS ids are broadcast

    def labelled(which: int) -> DataFrame:
        ids = learnt.filter(F.col("label") == which).select("doc_id")
        return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")

    if learnt.select("label").distinct().count() < 2:
        return None
    tables = {kind: kneser_ney(kind, labelled(1), labelled(0), docs.select("text")) for kind in (WORDS, LETTERS)}
    since = written()
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    fit = rated(sample, tables).select("label", *FEATURES).limit(2 * FIT_ROWS).toPandas()  # ids may repeat
    release(since)
    if fit["label"].nunique() < 2:
        return None
    fit = fit.sort_values(list(fit.columns))  # sums in one order
    w, mean, scale = logistic(fit[FEATURES].to_numpy(), fit["label"].to_numpy(float))
    return {"tables": tables, "w": w, "mean": mean, "scale": scale}


def curve(model: dict) -> Column:
    """The score of FEATURES."""
    z = F.lit(float(model["w"][-1]))
    for name, w, mean, scale in zip(FEATURES, model["w"], model["mean"], model["scale"], strict=False):
        z = z + (F.col(name) - float(mean)) / float(scale) * float(w)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def score(docs: DataFrame, model: dict | None, column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, a double from 0 to 1, as ``column`` (see free_name)."""
    column = free_name(docs, column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    return rated(docs, model["tables"]).select(*docs.columns, curve(model).alias(column))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their columns; texts of others alone are shuffled."""
    model = train(docs, labels)
    if model is None:
        return docs
    key = free_name(docs, "_key")
    gone = stored(measured(docs, model["tables"]).filter(curve(model) >= THRESHOLD).select(F.col("of").alias(key)), "toxic-gone")
    keyed = docs.withColumn(key, text_key())
    near, far = parted(keyed, F.xxhash64(F.col(key)), bit_map(gone, F.xxhash64(F.col(key)), "toxic-map"))
    return near.join(gone, key, "left_anti").select(*docs.columns).unionByName(far.select(*docs.columns))
