"""FM-index over a shard of words: suffix order, wavelet matrix of its last column, sampled positions.

Symbols are word numbers from 1; 0 separates. Separators differ from each other (each is as great as
its position), so suffixes never tie beyond one, and doubling ends once the longest repeat is covered.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with rank, 64 bits a word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, _Bits, int]] = []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            one = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, _Bits(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def get_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            c |= one.astype(c.dtype) << bit
        return c, i - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; the last symbol must be a separator."""
    n = len(symbols)
    separators, words = np.flatnonzero(symbols == 0), np.flatnonzero(symbols)
    first = len(separators)
    if not len(words):
        return separators
    rank = np.empty(n, np.int64)
    rank[separators] = np.arange(first)
    rank[words] = first + symbols[words]
    span = np.int64(max(n, int(symbols.max()) + first) + 1)
    key = rank[words] * span + rank[words + 1]
    order = np.argsort(key, kind="stable")
    sa, key = words[order], key[order]
    at, step = np.arange(len(sa)), 2  # at: places of sa that the rows in hand take
    rows = sa
    while True:
        new = np.empty(len(rows), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        rank[rows] = first + np.repeat(at[heads], np.diff(np.append(heads, len(rows))))
        last = np.append(new[1:], True)
        tied = ~(new & last)
        if not tied.any():
            return np.concatenate([separators, sa])
        rows, at = rows[tied], at[tied]
        key = rank[rows] * span + rank[rows + step]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        sa[at] = rows
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 32) -> None:
        symbols = np.append(symbols, 0) if not len(symbols) or symbols[-1] else symbols
        sa = suffix_order(symbols)
        self.n = len(sa)
        last = symbols[sa - 1]  # of position 0 the final separator
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma + 1), out=self.first[1:])
        self.wavelet = WaveletMatrix(last.astype(np.int32), sigma)
        # a step back over a separator isn't possible, so what follows one is sampled as well
        sampled = (sa % sample == 0) | (last == 0)
        self.sampled, self.samples = _Bits(sampled), sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns (rows of one length): first and last+1 row of each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j].astype(np.int64)
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back by last-to-first until a sampled row."""
        out, rows, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(at):
            done = self.sampled.get(rows).astype(bool)
            out[at[done]] = self.samples[self.sampled.rank(rows[done])] + steps
            at, rows = at[~done], rows[~done]
            c, r = self.wavelet.get_rank(rows)
            rows = self.first[c] + r
            steps += 1
        return out
