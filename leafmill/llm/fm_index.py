"""A compressed full-text index of integer sequences, searched for many queries at once with numpy.

``FMIndex`` keeps the Burrows-Wheeler transform of its sequences in a wavelet matrix (bit vectors
with counts, one for each bit of a symbol) and marks where neighbouring suffixes differ within
their first ``length`` symbols, and within one less.  The latter shorten a match from its right end,
so matching statistics cut at ``length`` take one step of backward search for each symbol that
matches.  Neither the sequences nor their suffix array are kept.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with counts before each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([np.zeros(1, np.int64), np.bitwise_count(self.words).cumsum(dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols by bit planes, the highest first; after each plane its zeros come before its ones."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.planes: list[tuple[int, BitVector, int]] = []
        for shift in reversed(range(max(1, (kinds - 1).bit_length()))):
            ones = (symbols >> shift & 1).astype(bool)
            self.planes.append((shift, BitVector(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        starts = np.flatnonzero(np.concatenate([np.ones(1, bool), symbols[1:] != symbols[:-1]]))
        self.first = np.zeros(kinds, np.int64)
        self.first[symbols[starts]] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        for shift, plane, zeros in self.planes:
            ones = plane.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def _suffixes(ranks: np.ndarray, longest: int, keep: set[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes in order, by doubling, and ranks by the first h symbols for each power h of two in ``keep``."""
    kept, h, n = {}, 1, len(ranks)
    while True:
        if h in keep:
            kept[h] = ranks
        if h > longest:
            return ranks.argsort(), kept
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = ranks[h:]
        key = ranks * np.int64(n + 1) + after
        order = key.argsort()
        key = key[order]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([np.zeros(1, np.int64), (key[1:] != key[:-1]).cumsum()])
        h *= 2


class FMIndex:
    """An index of sequences of symbols.

    ``symbols`` are the sequences (any integers), one behind the other, ``sizes`` their lengths, ``values`` a number
    for each.  ``search`` finds the windows of ``length`` symbols that a sequence has, and the least value of those
    sequences.  Sequences may be empty, equal or shorter than a window.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, values: np.ndarray, length: int) -> None:
        self.length, self.alphabet = length, np.unique(symbols)
        text = np.zeros(len(symbols) + len(sizes), np.int64)  # 0 ends each sequence
        ends = (sizes + 1).cumsum() - 1
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.searchsorted(self.alphabet, symbols) + 1
        ranks = text + len(sizes)
        ranks[ends] = np.arange(len(sizes))  # no two ends are equal, so nothing matches across one
        powers = lambda n: [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        order, kept = _suffixes(ranks, max(int(sizes.max(initial=0)), length), {*powers(length), *powers(length - 1)})
        self.size = len(text)
        self.marks, self.starts = {}, {}
        for n in (length, length - 1):
            new, off = np.arange(self.size) == 0, 0
            for h in powers(n):
                r = kept[h][np.minimum(order + off, self.size - 1)]
                new[1:] |= r[1:] != r[:-1]
                off += h
            self.marks[n], self.starts[n] = BitVector(new), np.flatnonzero(new)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.least = np.minimum.reduceat(values[owner[order]], self.starts[length]) if self.size else values
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.before = np.concatenate([np.zeros(1, np.int64), np.bincount(text, minlength=len(self.alphabet) + 1).cumsum()])

    def _shorter(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches of ``length`` symbols without their last symbol."""
        marks, starts = self.marks[self.length - 1], self.starts[self.length - 1]
        after = marks.rank(hi)
        end = np.where(after < len(starts), starts[np.minimum(after, len(starts) - 1)], self.size)
        return starts[marks.rank(lo + 1) - 1], end

    def search(self, symbols: np.ndarray, sizes: np.ndarray, none: int) -> np.ndarray:
        """For each symbol of the queries the least value of a sequence that has the window which starts there, else ``none``.

        Backward search from the end of each query.  A match that can't be extended is begun anew one symbol further left.
        """
        out = np.full(len(symbols), none, self.least.dtype)
        if not self.size or not len(self.alphabet):
            return out
        place = np.searchsorted(self.alphabet, symbols)
        code = np.where(self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == symbols, place + 1, 0)
        first = sizes.cumsum() - sizes
        live = np.flatnonzero(sizes >= self.length)
        start, at = first[live], first[live] + sizes[live] - 1  # of a query; its symbol to read
        end, lo, hi = at + 1, np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(at):
            full = end - at - 1 == self.length
            if full.any():
                lo[full], hi[full] = self._shorter(lo[full], hi[full])
                end[full] -= 1
            c = code[at]
            base = self.before[c]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = base + both[: len(c)], base + both[len(c) :]
            lost = (hi <= lo) | (c == 0)
            if lost.any():  # what is read again ends one symbol earlier, or before an unknown symbol
                end = np.where(lost, np.where(c == 0, at, end - 1), end)
                at = np.where(lost, end, at)
                lo, hi = np.where(lost, 0, lo), np.where(lost, self.size, hi)
            found = ~lost & (end - at == self.length)
            out[at[found]] = self.least[self.marks[self.length].rank(lo[found] + 1) - 1]
            at = at - 1
            stay = at >= start
            if lost.any():
                stay &= end - start >= self.length
            if not stay.all():
                start, at, end, lo, hi = start[stay], at[stay], end[stay], lo[stay], hi[stay]
        return out
