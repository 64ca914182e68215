"""A compressed FM-index over a sequence of integers, for many searches at once.

Only the Burrows-Wheeler transform is kept, in a wavelet matrix (for each bit of a symbol a packed bit vector with counts every
64 bits), with the place in the text of every RATE-th symbol.  The text itself and the suffix array are dropped.  Suffixes are
sorted as far as the searches are long, which is all that backward search of such lengths needs.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: Of so many places of the text one is kept.
RATE = 4


class Bits:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & ONE).astype(bool)


class WaveletMatrix:
    """Counts of a symbol before a place, over integers below 2**levels."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels, self.planes, self.zeros = max(1, int(top).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.planes.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places go when the symbol's bits are followed; differences of these are counts of the symbol."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.planes[i].ones(at)
            at = np.where((symbol >> level & 1).astype(bool), self.zeros[i] + ones, at - ones)
        return at

    def follow(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and where the places go when those are followed."""
        symbol = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(at), plane.ones(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """text: integers; 0 ends each of its parts and is in no search.  weights: how often each place of the text counts."""

    def __init__(self, text: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.symbols, dense = np.unique(np.concatenate([[0], text]), return_inverse=True)
        dense = dense[1:].astype(np.int64)
        order = _sorted(dense)
        before = dense[order - 1]  # the first suffix's is the last symbol, which ends a part
        self.matrix = WaveletMatrix(before, len(self.symbols) - 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=len(self.symbols)))])
        every = np.arange(len(self.symbols))
        self.origin = self.matrix.walk(every, np.zeros(len(every), np.int64))
        kept = (order % RATE == 0) | (before == 0)  # so that a walk back never leaves its part
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)
        #: How often the suffixes before each one count.
        self.counts = np.arange(len(text) + 1) if weights is None else np.concatenate([[0], np.cumsum(weights[order])])

    def coded(self, stream: np.ndarray) -> np.ndarray:
        """A stream's integers as the index's symbols; 0 for those that it lacks."""
        at = np.minimum(np.searchsorted(self.symbols, stream), len(self.symbols) - 1)
        return np.where(self.symbols[at] == stream, at, 0)

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a coded stream: for each end the length of the longest sequence that ends there, of at most
        ``most`` symbols, and counts at least ``least`` times in the index; and the range of suffixes that it begins.

        Backward search of all ends together; a search is left as soon as its sequence counts less.
        """
        length, low, high = (np.zeros(len(ends), np.int64) for _ in range(3))
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.first[-1])
        for back in range(int(most.max()) if len(most) else 0):
            live, lo, hi = (x[most[live] > back] for x in (live, lo, hi))
            symbol = stream[ends[live] - back]
            start = self.first[symbol] - self.origin[symbol]
            lo, hi = start + self.matrix.walk(symbol, lo), start + self.matrix.walk(symbol, hi)
            many = (symbol > 0) & (self.counts[hi] - self.counts[lo] >= least)
            live, lo, hi = live[many], lo[many], hi[many]
            length[live], low[live], high[live] = back + 1, lo, hi
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of some suffixes: a walk back to the next place that is kept."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            here = self.kept.get(rows[live])
            done = live[here]
            out[done] = self.places[self.kept.ones(rows[done])] + steps[done]
            live = live[~here]
            symbol, at = self.matrix.follow(rows[live])
            rows[live] = self.first[symbol] + at - self.origin[symbol]
            steps[live] += 1
        return out


def _sorted(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each end of a part differs from all others."""
    n, size = len(text), 1
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    while n:
        top = int(rank.max()) + 2
        if top > 3_000_000_000:
            raise OverflowError("shard too large")
        follow = np.zeros(n, np.int64)
        follow[: n - size] = rank[size:] + 1
        key = rank * top + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        size *= 2
        if rank[order[-1]] == n - 1 or size >= n:
            break
    return order
