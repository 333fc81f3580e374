"""An FM-index over a sequence of small integers: wavelet ranks, backward search, sampled positions.

Symbol 0 separates runs and never matches. Everything is done for many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text, and at each start of a run, the position itself is kept.
SAMPLE = 16
PACKED_BITS = 21


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Each separator is a symbol of its own, in order of its place."""
    n = len(text)
    symbols = text.astype(np.int64)
    zero = symbols == 0
    symbols += int(zero.sum())
    symbols[zero] = np.arange(int(zero.sum()))
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    at = np.arange(n, dtype=np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        if n < 1 << PACKED_BITS:  # key and place fit one word, and words sort fastest
            packed = np.sort((key << PACKED_BITS) | at)
            order, key = packed & ((1 << PACKED_BITS) - 1), packed >> PACKED_BITS
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with ranks: 64-bit words, and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)


class Wavelet:
    """Ranks of symbols, one bit vector for each bit of a symbol, from the topmost down."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int((~ones).sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(1 << self.depth)
        self.bottom = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.bottom[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at - self.bottom[symbol]


class FMIndex:
    """``text``: symbols 0 .. n_symbols - 1, the last one a separator."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.wavelet.depth))])
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept = Bits(kept)
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of each pattern; patterns are right-aligned rows of a matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, -k]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: walk back to the next kept one."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = self.kept.get(rows)
            out[todo[here]] = self.places[self.kept.rank(rows[here])] + steps
            todo, rows, steps = todo[~here], rows[~here], steps + 1
            symbol, before = self.wavelet.access(rows)
            rows = self.smaller[symbol] + before
        return out
