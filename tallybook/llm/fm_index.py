"""FM-index over a sequence of integer symbols: wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes.

    Separators count as distinct symbols in the order of their positions, so no
    comparison runs past the end of a text. Prefixes of as many symbols as fit
    into 62 bits are sorted first; then only positions that are still tied are
    sorted again by the rank of what follows, over doubling lengths.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, 62 // bits)
    # A prefix ends after its first separator; the rest counts as zeros.
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        following = np.zeros(n, np.int64)
        following[: max(0, n - k)] = symbols[k:]
        key = (key << bits) | np.where(alive, following, 0)
        alive &= following != SEPARATOR
    order = np.argsort(key, kind="stable")
    ended = ~alive  # told apart by position, which the stable sort kept
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[order[1:]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    step = width
    while True:
        tied = np.zeros(n, bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        group = first[rows]
        inner = np.lexsort((after, group))
        at, after, group = at[inner], after[inner], group[inner]
        order[rows] = at
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[rows] = fresh
        first[rows] = np.maximum.accumulate(np.where(fresh, rows, 0))
        rank[at] = first[rows]
        step *= 2


class Bits:
    """A bit vector with a rank directory of one count per 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[:-1]
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Symbols by bit planes, the highest first, zeros kept before ones in each plane."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.planes: list[tuple[Bits, int]] = []
        for level in reversed(range(self.levels)):
            ones = (symbols >> level) & 1 == 1
            plane = Bits(ones)
            self.planes.append((plane, len(symbols) - plane.ones))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(at), at
        for (plane, zeros), level in zip(self.planes, reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            a, b = plane.rank(start), plane.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for plane, zeros in self.planes:
            one, before = plane.get(at), plane.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + before, at - before)
        return symbol


class FMIndex:
    """Backward search and location over one shard of texts joined by separators."""

    def __init__(self, symbols: np.ndarray, sample: int = 16) -> None:
        """``symbols`` ends with a separator; every ``sample``-th position and every
        position after a separator keeps its place."""
        symbols = symbols.astype(np.int64)
        order = suffix_order(symbols)
        self.size = len(symbols)
        before = symbols[order - 1] if self.size else symbols
        self.tree = WaveletTree(before)
        top = int(symbols.max()) + 1 if self.size else 1
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top))))
        marked = (order % sample == 0) | (before == SEPARATOR)
        self.marked, self.places = Bits(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of equally long phrases, one per row of ``phrases``.

        A phrase with a symbol the shard doesn't have gets an empty interval.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        known = (phrases < len(self.smaller) - 1).all(axis=1)
        high[~known] = 0
        live = np.flatnonzero(known)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k].astype(np.int64)
            base = self.smaller[symbol]
            both = self.tree.rank(np.tile(symbol, 2), np.concatenate((low[live], high[live])))
            low[live], high[live] = base + both[: len(live)], base + both[len(live) :]
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: each walks back to a row whose place is kept."""
        places, steps, pending = np.empty_like(rows), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(pending):
            at = rows[pending]
            kept = self.marked.get(at)
            done = pending[kept]
            places[done] = self.places[self.marked.rank(at[kept])] + steps
            pending, at = pending[~kept], at[~kept]
            symbol = self.tree.access(at)
            rows[pending] = self.smaller[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return places
