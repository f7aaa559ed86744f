"""FM-index over a sequence of integer symbols, in numpy: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.  Symbol 0 is a separator: each one differs from all others, ordered by place."""
    n = len(symbols)
    gap = symbols == 0
    rank = symbols.astype(np.int64) + int(gap.sum())
    rank[gap] = np.arange(int(gap.sum()))
    span = 1
    while True:
        following = np.full(n, -1, np.int64)
        following[: max(0, n - span)] = rank[span:]
        key = rank * (int(rank.max()) + 2) + following + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if fresh[order[-1]] == n - 1:
            return order
        rank, span = fresh, span * 2


class Wavelet:
    """Wavelet matrix: ``rank(c, i)`` is the number of ``c`` among the first ``i`` symbols."""

    def __init__(self, symbols: np.ndarray, highest: int):
        self.bits = max(1, int(highest).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            on = (symbols >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(on))).astype(np.int32))
            self.zeros.append(len(symbols) - int(on.sum()))
            symbols = np.concatenate((symbols[on == 0], symbols[on == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            on = (c >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(on, zeros + a, low - a), np.where(on, zeros + b, high - b)
        return high - low


class FMIndex:
    """Index of ``symbols``, which end with a separator (0)."""

    def __init__(self, symbols: np.ndarray, highest: int, every: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.last = before.astype(np.int64)
        self.wavelet = Wavelet(before, highest)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=highest + 1))))[:-1].astype(np.int64)
        # Sampled positions: every so many symbols, and after each separator, so that no walk has to cross one.
        self.sampled = (order % every == 0) | (before == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]
        self.n = len(symbols)

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``patterns`` at once: first and last + 1 of their suffixes."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        open_ = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[open_, k]
            low[open_] = self.first[c] + self.wavelet.rank(c, low[open_])
            high[open_] = self.first[c] + self.wavelet.rank(c, high[open_])
            open_ = open_[low[open_] < high[open_]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, position) of each occurrence."""
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        steps = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            c = self.last[rows[open_]]
            rows[open_] = self.first[c] + self.wavelet.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return which, self.positions[self.place[rows]] + steps
