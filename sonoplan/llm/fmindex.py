"""FM-index over word ids: wavelet matrix, backward search, matching statistics up to a length.

The order of suffixes is exact in their first 16 symbols, which is all that patterns of up
to 15 symbols need: the rows of the index that start with a pattern are contiguous, and
one backward step with symbol a maps them to C[a] plus the rank of a in the last column.
All searches of a batch advance together, one numpy pass per bit of the alphabet.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class WaveletMatrix:
    """Rank over a sequence of small integers; per bit a bitmap with a count per 64 positions."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n, self.maps, self.counts, self.zeros = len(seq), [], [], []
        words = len(seq) // 64 + 1
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            padded = np.zeros(words * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int32)
            self.maps.append(packed)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            keep = bit.astype(bool)
            seq = np.concatenate([seq[~keep], seq[keep]])
            self.zeros.append(len(bit) - int(keep.sum()))
        self.first = np.zeros(0, np.int64)
        self.first = self.move(np.arange(sigma), np.zeros(sigma, np.int64))

    def move(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position after all levels; minus ``first[symbol]`` it is the rank of the symbol before ``at``."""
        for k in range(self.bits):
            word = at >> 6
            low = self.maps[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(low)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.move(symbol, at) - self.first[symbol]


class FmIndex:
    """Index of sequences over symbols 1..sigma-1, joined with symbol 0 after each."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = len(text)
        self.n, self.ranks = n, {1: text.astype(np.int64)}
        padded = lambda r, k: np.append(r[k:], np.zeros(min(k, n), np.int64))
        rank, k = self.ranks[1], 1
        while k < DEPTH:
            key = rank * np.int64(int(rank.max(initial=0)) + 1) + padded(rank, k)
            order = np.argsort(key)
            new = np.ones(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            k *= 2
            self.ranks[k] = rank
        self.order = order if n else np.zeros(0, np.int64)
        counts = np.bincount(text, minlength=sigma)
        self.c = np.cumsum(counts) - counts
        self.last = WaveletMatrix(text[self.order - 1] if n else text, sigma)
        same = np.zeros(n, np.int64)  # common prefix with the row before, up to 15 symbols
        if n:
            a, b = self.order[:-1], self.order[1:]
            got = np.zeros(n - 1, np.int64)
            for k in (8, 4, 2, 1):
                i, j = a + got, b + got
                inside = (i < n) & (j < n)
                r = self.ranks[k]
                got += k * (inside & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)]))
            same[1:] = got
        self.same, self.groups = same, {}
        self.ranks = {}

    def group(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row, the first and one past the last row that share ``depth`` symbols."""
        if depth not in self.groups:
            starts = np.flatnonzero(np.append(True, self.same[1:] < depth)) if self.n else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, self.n))
            self.groups[depth] = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        return self.groups[depth]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: rows of the pattern with ``symbol`` put before it."""
        base = self.c[symbol]
        return base + self.last.rank(symbol, lo), base + self.last.rank(symbol, hi)

    def matching(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int):
        """Matching statistics of the sequences ``text[starts:ends]``, streamed from their ends.

        Yields (sequence, position, length, lo, hi) arrays step by step: the longest match, of
        ``limit`` symbols at most, that begins at the position, and its rows. A symbol that the
        index lacks is given as 0 and matches nothing.
        """
        if limit >= DEPTH:
            raise ValueError(f"limit must be under {DEPTH}")
        live, at = np.arange(len(starts)), ends - 1
        lo, hi, size = np.zeros(len(starts), np.int64), np.full(len(starts), self.n), np.zeros(len(starts), np.int64)
        while True:
            go = at >= starts[live]
            live, at, lo, hi, size = live[go], at[go], lo[go], hi[go], size[go]
            if not len(live):
                return
            full = size == limit
            if full.any():
                a, b = self.group(limit - 1)
                lo, hi, size = np.where(full, a[np.minimum(lo, self.n - 1)], lo), np.where(full, b[np.minimum(lo, self.n - 1)], hi), size - full
            symbol = text[at]
            nlo, nhi = self.extend(symbol, lo, hi)
            size = size + 1
            bad = np.flatnonzero((nlo >= nhi) | (symbol == 0))
            while len(bad):  # drop symbols at the far end until the step succeeds
                size[bad] -= 1
                none = (size[bad] <= 0) | (symbol[bad] == 0)
                gone = bad[none]
                nlo[gone], nhi[gone], size[gone] = 0, self.n, 0
                bad = bad[~none]
                for d in np.unique(size[bad]):
                    own = bad[size[bad] == d]
                    if d > 1:
                        a, b = self.group(int(d) - 1)
                        lo[own], hi[own] = a[lo[own]], b[lo[own]]
                    else:
                        lo[own], hi[own] = 0, self.n
                    nlo[own], nhi[own] = self.extend(symbol[own], lo[own], hi[own])
                bad = bad[nlo[bad] >= nhi[bad]]
            lo, hi = nlo, nhi
            yield live, at, size, lo, hi
            at = at - 1
