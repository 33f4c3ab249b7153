"""An FM-index over a sequence of integer symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions.

What is kept are bits and their counts a machine word, and the sampled positions; the suffix array and the transform
itself are dropped once the index is built.
"""

from __future__ import annotations

import numpy as np

#: Every so many symbols of a segment the index keeps the position.
SAMPLE_RATE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Symbol 0 closes a segment; each 0 sorts as a symbol of its own, before all others."""
    closing = symbols == 0
    rank = np.where(closing, np.cumsum(closing) - 1, symbols.astype(np.int64) + closing.sum())
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_keys = key[order]
        steps = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        k *= 2
        if steps[-1] == n - 1 or k >= n:
            return order


class Bits:
    """A bit vector in machine words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, upto: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word = upto >> 6
        below = self.words[word] & ((np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)


class WaveletTree:
    """Counts of a symbol in any prefix, for many questions at once; one bit vector a level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1 == 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place `upto`. A symbol beyond all levels stands nowhere."""
        low, high = np.zeros_like(upto), upto.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbols >> level) & 1 == 1
            a, b = self.bits[k].rank(low), self.bits[k].rank(high)
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return np.where(symbols >> self.levels, 0, high - low)

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbol, low, place = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.levels):
            one = self.bits[k].get(place)
            a, b = self.bits[k].rank(low), self.bits[k].rank(place)
            low, place = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, place - b)
            symbol = symbol * 2 + one
        return symbol, place - low


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """symbols: positive numbers in segments, each closed by a 0."""
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.tree = WaveletTree(symbols[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        starts = np.concatenate([[0], np.flatnonzero(symbols == 0)[:-1] + 1])
        lengths = np.diff(np.concatenate([starts, [self.n]]))
        sampled = ((np.arange(self.n) - np.repeat(starts, lengths)) % SAMPLE_RATE == 0)[order]
        self.sampled = Bits(sampled)
        self.positions = order[sampled].astype(np.int32)

    def _first(self, symbols: np.ndarray) -> np.ndarray:
        return self.before[np.minimum(symbols, len(self.before) - 1)]

    def search(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns, each `lengths` symbols of stream from `starts` on. Those that occur: their numbers and ranges of suffixes."""
        at = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(at):
            done = lengths[at] == step
            found.append((at[done], low[done], high[done]))
            at, low, high = at[~done], low[~done], high[~done]
            symbols = stream[starts[at] + lengths[at] - 1 - step].astype(np.int64)
            first = self._first(symbols)
            low, high = first + self.tree.rank(symbols, low), first + self.tree.rank(symbols, high)
            there = (low < high) & (symbols > 0)
            at, low, high = at[there], low[there], high[there]
            step += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each steps back in the sequence until it meets a sampled one."""
        out = np.empty(len(rows), np.int64)
        at, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            hit = self.sampled.get(rows)
            out[at[hit]] = self.positions[self.sampled.rank(rows[hit])] + steps
            at, rows = at[~hit], rows[~hit]
            symbols, ranks = self.tree.symbol_and_rank(rows)
            rows = self._first(symbols) + ranks
            steps += 1
        return out
