"""An FM-index over word numbers: suffix array by prefix doubling, wavelet matrix with ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Of every run one suffix in STEP has its position stored.
STEP = 16


def starts_of(flags: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it whose flag is set."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose symbols are compared as numbers. Only suffixes not yet told apart are sorted again."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    own = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = starts_of(np.r_[True, own[1:] != own[:-1]])
    width = 1
    while True:
        by = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(by[rank] > 1)
        if not len(open_):
            break
        after = open_ + width
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        at, key = open_[turn], key[turn]
        old = rank[at]
        group = starts_of(np.r_[True, old[1:] != old[:-1]])
        part = starts_of(np.r_[True, key[1:] != key[:-1]])
        rank[at] = old + part - group
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with ranks from counts before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """seq: word numbers from 1, with 0 after each run; a run is never matched across its 0."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        ends = np.flatnonzero(seq == 0)
        first = seq + len(ends)
        first[ends] = np.arange(len(ends))
        order = suffix_array(first)
        bwt = seq[order - 1]
        self.n = n
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        self.levels: list[tuple[int, Bits, int]] = []
        level = bwt
        for shift in reversed(range(max(1, symbols.bit_length()))):
            bit = (level >> shift) & 1
            zeros = int(n - bit.sum())
            self.levels.append((shift, Bits(bit.astype(np.uint8)), zeros))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        run = np.r_[0, ends[:-1] + 1]
        within = np.arange(n) - np.repeat(run, np.diff(np.r_[run, n]))
        stored = (within % STEP == 0)[order]
        self.stored = Bits(stored.astype(np.uint8))
        self.places = order[stored]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol is before place i of the transform."""
        start = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that is longer by one word."""
        i, start, symbol = row, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for _, bits, zeros in self.levels:
            one = bits.get(i) == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            symbol = symbol * 2 + one
        return self.before[symbol] + i - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: (which phrase, place in seq) of every occurrence."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, k]
            low, high = self.before[symbol] + self.rank(symbol, low), self.before[symbol] + self.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        size = high - low
        row = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(alive, size), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, left, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(left):
            hit = self.stored.get(row) == 1
            out[left[hit]] = self.places[self.stored.rank(row[hit])] + steps
            left, row = left[~hit], row[~hit]
            row, steps = self.back(row) if len(row) else row, steps + 1
        return out
