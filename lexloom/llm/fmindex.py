"""A compressed FM-index over integer symbols, searched for many patterns at once.

The Burrows-Wheeler transform of all indexed sequences is held in a wavelet
matrix: one bit vector a level, packed in 64-bit words with a running count a
word, so a rank is two gathers and a population count.  Backward search runs in
lockstep: each step extends every pattern by one symbol.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the text must end in a unique symbol."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    k = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = rank[k:] + 1
        keys, rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead, return_inverse=True)
        if len(keys) == n:
            return np.argsort(rank)
        k *= 2


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.uint32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        w = i >> 6
        below = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[BitVector] = []
        at = np.asarray(symbols, np.int64)
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((at >> b) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, v in enumerate(self.levels):
            one = v.rank(i)
            i = np.where((c >> (top - k)) & 1, v.zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._walk(c, i) - self.start[c]


class FMIndex:
    """Index of sequences (flat symbols >= 0, cut at ``first``)."""

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        self.alphabet, code = np.unique(flat, return_inverse=True)
        self.code, self.first = code.astype(np.int64), first
        m, size = len(first) - 1, np.diff(first)
        # every sequence ends in a separator of its own, smaller than all symbols
        text = np.empty(len(flat) + m, np.int64)
        inside = np.arange(len(flat)) + np.repeat(np.arange(m), size)
        text[inside] = code + m
        text[first[1:] + np.arange(m)] = np.arange(m)
        sa = suffix_array(text)
        bwt = np.maximum(text[sa - 1] - m + 1, 0)  # separators are never searched for
        sigma = len(self.alphabet) + 1
        self.n = len(text)
        self.occ = WaveletMatrix(bwt, sigma)
        self.less = m + np.r_[0, 0, np.cumsum(np.bincount(code, minlength=len(self.alphabet)))]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c·P from those of P."""
        both = self.occ.rank(np.concatenate([c, c]) + 1, np.concatenate([lo, hi]))
        base = self.less[c + 1]
        return base + both[: len(c)], base + both[len(c) :]

    def matches(self, rows: np.ndarray, length: int, least: int = 2) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics above a threshold.

        Streams the indexed sequences ``rows`` from right to left and reports
        ``(row, start, end)`` arrays: maximal stretches of at least ``length``
        symbols that occur ``least`` times or more in the index.  Together they
        cover each such window.
        """
        begin, row = self.first[rows], rows
        e = self.first[rows + 1].copy()
        i, lo, hi = e.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        out = []
        live = np.flatnonzero(e - begin >= length)
        begin, row, e, i, lo, hi = (x[live] for x in (begin, row, e, i, lo, hi))
        while len(row):
            new_lo, new_hi = self.extend(self.code[i - 1], lo, hi)
            good = new_hi - new_lo >= least
            i = i - good
            lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
            stop = ~good | (i == begin)
            found = np.flatnonzero(stop & (e - i >= length))
            if len(found):
                out.append((row[found], i[found] - begin[found], e[found] - begin[found]))
            # windows left of i end before e, and before i + length
            broke = np.flatnonzero(~good)
            e[broke] = np.minimum(e[broke] - 1, i[broke] + length - 1)
            i[broke], lo[broke], hi[broke] = e[broke], 0, self.n
            keep = ~(good & (i == begin)) & (e - begin >= length)
            if not keep.all():
                begin, row, e, i, lo, hi = (x[keep] for x in (begin, row, e, i, lo, hi))
        return out
