"""BPE encoding and decoding by speculation and verification (operator 4).

A word is first cut greedily into the longest vocabulary entries.  The cut is the BPE result exactly if each entry is its
own BPE result and no merge crosses any of the cuts; both are tested for all adjacent pairs of all new words at once with
array operations on the merge table (``crosses``).  Only words that fail undergo the exact merging (``merge_word``).

Texts are normalised and split in one fixed way (SPLIT, END); vocabulary, merges and special tokens come from the file.  Special
tokens are found in the raw text, the rest is NFC, white space to one space, lower case by code point; words are contractions,
runs of letters, single numerals and runs of other characters; the last symbol of a word carries the end-of-word mark.

Decoding works on ids alone: the names of a text's tokens, gathered from one table of bytes, with a blank between them.

Defined results: a null or empty text has no tokens and decodes to the empty text; order and repeated rows don't matter;
memory is bounded by one Arrow batch and a cache of CACHE_WORDS words; extra columns are carried, and where one has the name of
a result already the result takes a longer one (``free_name``).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._store import free_name
from ._text import trimmed

#: Fixed values of the tokenizer's file: the split pattern and the end-of-word mark.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: The code that follows a word's letters, which have 0 to 255.
END_CODE = 256
#: Longer words are merged one by one, by a queue.
SHORT = 32
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Words, and pieces between white space, whose tokens a task keeps; the cache starts anew beyond it.
CACHE_WORDS = 200_000
#: A longer word isn't cached.
CACHE_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in own else spare))
        spare += b not in own
    return letters


class Table:
    """A fixed map from non-negative integers to integers, looked up by arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        rest, step = np.arange(len(keys)), 0
        while len(rest):  # all keys at once; those that find their place taken go one place on
            at = self._place(keys[rest], step)
            free = self.keys[at] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[rest[put]], values[rest[put]]
            rest, step = rest[~put], step + (~put).any()
        self.steps = step + 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if there is none."""
        at = self._place(keys, 0)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        step = 1
        while len(rest) and step < self.steps:
            at = self._place(keys[rest], step)
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest, step = rest[~hit & (found >= 0)], step + 1
        return out


class WordBPE:
    """Encoder and decoder for a vocabulary file with word ends."""

    def __init__(self, spec: bytes) -> None:
        file = json.loads(spec)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: What all special tokens begin with: a text without it holds none.
        self.mark = os.path.commonprefix(list(self.special))
        self.words = regex.compile(SPLIT)
        self.letters = byte_letters()
        size = max(self.names) + 1
        #: The tokens' names with a blank after each, one after the other, and where they begin.
        spelt = [self.names.get(i, "").encode() + b" " for i in range(size)]
        self.spelt, self.spelt_begin = np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, spelt)))])
        never = np.iinfo(np.int64).max
        #: By token: the rank of the merge that makes it (-1: a symbol) and that merge's parts.
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        pairs, made = [], []
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
            pairs.append(x * size + y)
            made.append(r)
        self.size, self.never = size, never
        firsts = np.unique(np.array(pairs, np.int64), return_index=True)[1]
        self.pairs = Table(np.array(pairs, np.int64)[firsts], np.array(made, np.int64)[firsts])
        self.made = np.array([self.vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]])
        own = self._own()
        #: Only tokens that BPE makes of their own text are proposed: a trie of them, by code of letter, END_CODE at a word's end.
        self.codes = {c: k for k, c in enumerate(self.letters)}
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for t, i in self.vocab.items():
            if own[i]:
                at = 0
                for c in [*map(self.codes.__getitem__, t.removesuffix(END)), *[END_CODE] * t.endswith(END)]:
                    at = nodes.setdefault((at, c), len(nodes) + 1)
                ends[at] = i
        self.trie = Table(np.array([n * 512 + c for n, c in nodes], np.int64), np.array(list(nodes.values())))
        self.ends = np.full(len(nodes) + 1, -1)
        self.ends[list(ends)] = list(ends.values())
        #: Each letter's symbol, within a word and at its end.
        self.symbols = np.array([[self.vocab[c], self.vocab[c + END]] for c in self.letters])
        self.known: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _own(self) -> np.ndarray:
        """Whether each token is its own BPE result: no earlier merge crosses the join of its parts, nor, in turn, of theirs."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(self.size, bool)
        good[made] = ~self.crosses(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made], kind="stable")]:
            good[i] &= good[self.left[i]] and good[self.right[i]]
        return good

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get(a * self.size + b)
        return np.where(r < 0, self.never, r)

    def crosses(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE, on the text of token a followed by token b, merges across the cut (before: with a rank below it).

        Both sides are taken apart from the last merge to the first.  At each moment the symbols beside the cut are known,
        as is the next event on either side; the pair is merged if its rank comes before that event.  Of equal ranks the
        leftmost comes first: events of the left side precede the pair, the pair precedes those of the right side.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), 2 * self.never // 2 - 1) if before is None else 2 * before.astype(np.int64)
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_rank(x, y)
            hit = (r != self.never) & (2 * np.where(r == self.never, 0, r) < limit[live])
            out[live[hit]] = True
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~hit & ((rx >= 0) | (ry >= 0))]
        return out

    def propose(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens, the word of each, and the words where it got stuck.

        text: codes of letters; each word is followed by END_CODE, which ends[i] points at.
        """
        best, size = np.full(len(text), -1), np.zeros(len(text), np.int64)
        place = np.arange(len(text))
        node, depth = np.zeros(len(text), np.int64), 0
        while len(place):
            node = self.trie.get(node * 512 + text[place + depth])
            going = node >= 0
            place, node = place[going], node[going]
            depth += 1
            token = self.ends[node]
            inside = text[place + depth - 1] != END_CODE
            hit = (token >= 0) & ~(inside & (text[np.minimum(place + depth, len(text) - 1)] == END_CODE))  # the last letter's token holds the end
            best[place[hit]], size[place[hit]] = token[hit], depth
            place, node = place[inside], node[inside]
        who, at = np.arange(len(starts)), starts.copy()
        tokens, owners, order, stuck, step = [], [], [], np.zeros(len(starts), bool), 0
        while len(who):
            token = best[at]
            bad = token < 0
            stuck[who[bad]] = True
            who, at, token = who[~bad], at[~bad], token[~bad]
            tokens.append(token)
            owners.append(who)
            order.append(np.full(len(who), step))
            at, step = at + size[at], step + 1
            left = at < ends[who]
            who, at = who[left], at[left]
        t, w, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, owners, order))
        by = np.lexsort((k, w))
        return t[by], w[by], stuck

    def merge_words(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Exact merging of many words of about the same size, one merge of each at a time."""
        n, wide = len(starts), int(sizes.max())
        column = np.arange(wide)
        inside = column < sizes[:, None]
        codes = text[np.minimum(starts[:, None] + column, len(text) - 1)]
        ids = np.where(inside, self.symbols[np.where(inside, codes, 0), (column == sizes[:, None] - 1).astype(int)], -1)
        if wide > 1:
            both = ids[:, 1:] >= 0
            ranks = np.full((n, wide - 1), self.never)
            ranks[both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
            live = np.arange(n)
            while len(live):
                j = ranks[live].argmin(1)
                r = ranks[live, j]
                live, j, r = (x[r != self.never] for x in (live, j, r))
                if not len(live):
                    break
                move = np.minimum(column + (column > j[:, None]), wide - 1)
                rows = np.take_along_axis(ids[live], move, 1)
                rows[:, -1] = -1
                rows[np.arange(len(live)), j] = self.made[r]
                own = np.take_along_axis(ranks[live], np.minimum(column[:-1] + (column[:-1] >= j[:, None]), wide - 2), 1)
                own[:, -1] = self.never
                for k in (j - 1, j):
                    ok = np.flatnonzero((k >= 0) & (k < wide - 1))
                    a, b = rows[ok, k[ok]], rows[ok, k[ok] + 1]
                    own[ok, k[ok]] = np.where(b >= 0, self.pair_rank(a, np.maximum(b, 0)), self.never)
                ids[live], ranks[live] = rows, own
        return [row[row >= 0] for row in ids]

    def merge_word(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones; linear space, time n log n."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        n = len(ids)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        merges = self.merges
        queue = [(*m, i, 0, 0) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        queue = [(r, i, z, 0, 0) for r, z, i, _, _ in queue]
        heapq.heapify(queue)
        while queue:
            _, i, z, vi, vj = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] < 0 or j >= n or version[i] != vi or version[j] != vj:
                continue
            ids[i], ids[j] = z, -1
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((z, ids[after[i]])):
                    heapq.heappush(queue, (m[0], i, m[1], version[i], version[after[i]]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], z))):
                heapq.heappush(queue, (m[0], p, m[1], version[p], version[i]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The tokens of each word (bytes as letters): proposals, all pairs verified at once, exact merging for what fails."""
        codes = self.codes
        text = np.array([c for w in words for c in [*map(codes.__getitem__, w), END_CODE]], np.int64)
        sizes = np.array(list(map(len, words)))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        tokens, owner, failed = self.propose(text, starts, ends)
        if len(tokens) > 1:
            same = owner[1:] == owner[:-1]
            keys, back = np.unique(tokens[:-1][same] * self.size + tokens[1:][same], return_inverse=True)
            failed[owner[1:][same][self.crosses(keys // self.size, keys % self.size)[back]]] = True
        cuts = np.searchsorted(owner, np.arange(len(words) + 1))
        out = [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        again = np.flatnonzero(failed)
        again = again[np.argsort(sizes[again], kind="stable")]
        short = again[sizes[again] <= SHORT]
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            for i, ids in zip(some, self.merge_words(text, starts[some], sizes[some]), strict=True):
                out[i] = ids
        for i in again[sizes[again] > SHORT]:
            out[i] = np.array(self.merge_word(words[i]))
        return out

    def forget(self) -> None:
        """Empties the caches, which a task fills for itself."""
        self.known, self.cache = {}, {}

    def normalise(self, text: str) -> str:
        """White space stays as it is: no word holds any, and all of it parts words alike."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by code point has no final form
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Parts of the text, between white space, that are encoded apart; special tokens stand as they are."""
        if self.special and self.mark in text:
            out, at = [], 0
            for m in self.split_special.finditer(text):
                out += self._pieces(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._pieces(text[at:])
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        text = self.normalise(text)
        if SEPARATORS.search(text):  # str.split() takes these for white space
            return self.words.findall(text)
        return text.split()

    def look_up(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't in the cache of pieces."""
        special = self.special
        split = {p: self.words.findall(p) for p in pieces if p not in special}
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in set().union(*split.values()) if w not in known] if split else []
        letters = self.letters
        now: dict[str, bytes] = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        if new:
            found = self.encode_words([w if w.isascii() and w.isprintable() else "".join(map(letters.__getitem__, w.encode())) for w in new])
            cut, raw = 0, np.concatenate(found).astype("<u4").tobytes()
            for w, f in zip(new, found, strict=True):
                end = cut + 4 * len(f)
                (known if len(w) <= CACHE_LENGTH else now)[w] = raw[cut:end]
                cut = end
        out = {}
        for p, ws in split.items():
            out[p] = (known.get(ws[0]) or now[ws[0]]) if len(ws) == 1 else b"".join([known.get(w) or now[w] for w in ws])
        return out | {p: now[p] for p in pieces if p in special}

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        lists = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = self.look_up({p for p in set().union(*lists) if p not in cache}) if lists else {}
        cache.update((p, e) for p, e in new.items() if len(p) <= CACHE_LENGTH)
        far = {p: e for p, e in new.items() if len(p) > CACHE_LENGTH}
        for ps in lists:
            yield b"".join([cache[p] if p in cache else far[p] for p in ps] if far else [cache[p] for p in ps])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, in UTF-8: the tokens' names with a blank between them; special tokens stand as they are."""
        parts = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at : at + (1 << 18)].astype(np.int64)
            size = self.spelt_begin[some + 1] - self.spelt_begin[some]
            place = np.arange(int(size.sum())) + np.repeat(self.spelt_begin[some] - (np.cumsum(size) - size), size)
            parts.append(self.spelt[place].tobytes())
        return b"".join(parts)[:-1]


_LOADED: dict[int, WordBPE] = {}


def loaded(spec: bytes) -> WordBPE:
    """The encoder for a vocabulary, made once a process."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(spec)
    return _LOADED[key]


#: Characters of text encoded at once.
CHARACTERS = 1 << 21


def runs(texts: list[str], limit: int = CHARACTERS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and n_tokens, and ids and decoded; digests: their SHA-256 in their place.

    vocabulary: path of the file, read by the driver and broadcast (its size is fixed).
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != text]
    names = [free_name(docs, n) for n in ("n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))]
    source = docs.select(*kept, text)
    kinds = ("long", "string" if digests else "array<int>", "string")
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, collecting = loaded(spec.value), gc.isenabled()
        gc.disable()  # nothing here forms cycles, and scanning the caches would take most of the time
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    counts, ids, decoded = [], [], []
                    for run in runs(part.column(len(kept)).to_pylist()):
                        for raw in bpe.encode_texts(run):
                            own = np.frombuffer(raw, "<u4")
                            back = bpe.decode(own)
                            counts.append(len(own))
                            ids.append(hashlib.sha256(raw).hexdigest() if digests else own.view("<i4"))
                            decoded.append(hashlib.sha256(back).hexdigest() if digests else back.decode())
                    made = [pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[*kept, *names])
        finally:
            bpe.forget()
            if collecting:
                gc.enable()

    return source.mapInArrow(trimmed(work), fields)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` and text, decoded from a column of ids (null: empty)."""
    with open(vocabulary, "rb") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    own, column = rows.columns, free_name(rows, "text")
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own), f"`{column}` string"])
    at = own.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)).decode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*own, column])

    return rows.mapInArrow(trimmed(work), fields)
