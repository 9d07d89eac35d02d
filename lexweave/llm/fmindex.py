"""FM-index over a sequence of word numbers, in vectors: suffix array, Burrows-Wheeler transform, wavelet matrix, samples."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, in which 0 separates. Every separator differs from every other one, so no suffix is
    compared beyond the run it starts in. Prefix doubling; the rounds grow with the log of the longest repeated run."""
    n = len(s)
    zero = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(zero)
    rank[zero] = np.arange(len(zero))
    k, order = 1, np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class Bits:
    """Bit vector with rank by blocks of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """``count`` by backward search, ``locate`` by walking to the next sampled suffix."""

    def __init__(self, s: np.ndarray, sample: int = 16) -> None:
        n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1].astype(np.int64)  # row of suffix 0 takes the last symbol, a separator
        self.levels = max(1, int(s.max()).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=1 << self.levels))))
        self.bits, rest = [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = s[:-1] == 0  # run starts are sampled, so no walk crosses a separator
        kept = (sa % sample == 0) | starts[sa]
        self.kept, self.samples, self.n = Bits(kept.astype(np.uint8)), sa[kept], n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols of the transform."""
        low = np.zeros_like(i)
        for k, bits in enumerate(self.bits):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, i - b)
        return i - low

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for bits in self.bits:
            one, r = bits.get(i), bits.rank(i)
            c, i = c * 2 + one, np.where(one, bits.zeros + r, i - r)
        return c

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern (one a line, all of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            known = c < 1 << self.levels
            high[live[~known]] = low[live[~known]] = 0
            live, c = live[known], c[known]
            low[live], high[live] = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
            live = live[high[live] > low[live]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = at[open_]
            done = self.kept.get(r)
            hit = open_[done]
            out[hit] = self.samples[self.kept.rank(at[hit])] + steps[hit]
            open_ = open_[~done]
            r = at[open_]
            c = self.symbol(r)
            at[open_] = self.first[c] + self.rank(c, r)
            steps[open_] += 1
        return out
