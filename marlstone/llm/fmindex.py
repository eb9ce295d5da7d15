"""FM-index over integer runs: suffix order, Burrows-Wheeler transform, wavelet-matrix ranks, sampled positions.

All searches work on arrays, so that every pattern takes its next backward step in one numpy call.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run one suffix position is kept; run starts are kept always.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros end runs; they sort first, each by its place, so runs are never compared past their end."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(1, int(ends.sum()) + 1)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.empty(n, dtype=bool)
        new[0] = False
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if step > 1:
            tail = second[order]
            new[1:] |= tail[1:] != tail[:-1]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(new) + 1
        rank = fresh
        if new[1:].all():
            return order
        second = np.zeros(n, dtype=np.int64)
        second[:-step] = rank[step:]
        order = np.argsort(rank * (n + 2) + second, kind="stable")
        step *= 2


class WaveletMatrix:
    """Rank of a symbol before a position, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = bits
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, elementwise."""
        low = np.zeros(len(at), dtype=np.int64)
        high = at.astype(np.int64)
        for k, (ones, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        at = at.astype(np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            out = out * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of ``text``: positive symbols in runs that end in 0; the last symbol must be 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        before = np.concatenate([text[-1:], text[:-1]])
        bwt = before[order]
        self.size = len(text)
        self.first = np.searchsorted(text[order], np.arange(symbols + 2))
        self.ranks = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        position = np.arange(len(text))
        keep = (before == 0) | (position % SAMPLE == 0)
        kept = keep[order]
        self.sampled_before = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]
        self.kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, one a row, padded with 0 at the left; empty where there is none."""
        m, width = patterns.shape
        low, high = np.zeros(m, dtype=np.int64), np.full(m, self.size, dtype=np.int64)
        live = np.arange(m)
        for k in range(width - 1, -1, -1):
            c = patterns[live, k]
            go = live[c > 0]
            c = c[c > 0]
            low[go] = self.first[c] + self.ranks.rank(c, low[go])
            high[go] = self.first[c] + self.ranks.rank(c, high[go])
            live = go[high[go] > low[go]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back to a sampled one and add the steps."""
        out = np.zeros(len(rows), dtype=np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            hit = self.kept[at]
            out[live[hit]] = self.sampled[self.sampled_before[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.ranks.symbol(at)
            at = self.first[c] + self.ranks.rank(c, at)
            steps += 1
        return out
