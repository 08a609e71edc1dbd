"""A full-text index of a word sequence: suffix array, wavelet tree, backward search, located occurrences."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be smaller than all others and occur once."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(depth, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        if step[-1] == n - 1 or depth >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[: n - depth] += rank[depth:] + 1
        depth *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        words = np.zeros(n // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i places."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class WaveletTree:
    """Ranks of any symbol, a bit vector for each binary digit, most significant first."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.height = max(1, (alphabet - 1).bit_length())
        self.levels, s = [], symbols
        for level in range(self.height - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            s = np.concatenate((s[~bit], s[bit]))
        every = np.arange(alphabet)
        self.origin = self.descend(every, np.zeros(alphabet, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, v in enumerate(self.levels):
            ones = v.ones(i)
            i = np.where(symbol >> (self.height - 1 - k) & 1, v.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first i places."""
        return self.descend(symbol, i) - self.origin[symbol]


class FMIndex:
    """Counts and locates patterns in ``symbols`` (values 1..alphabet-1; 0 is the end mark it adds)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_order(text)
        self.n, self.last = len(text), text[order - 1]
        self.tree = WaveletTree(self.last, alphabet)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        kept = order % sample == 0
        self.sampled, self.positions, self.kept = Bits(kept), order[kept], kept

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each row of ``patterns``, all of one length, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.below[c] + self.tree.rank(c, low[live])
            high[live] = self.below[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        gone = np.ones(len(patterns), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, walking back to the next sampled one."""
        rows, found, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            hit = self.kept[at]
            done = live[hit]
            found[done] = self.positions[self.sampled.ones(at[hit])] + steps[done]
            live, at = live[~hit], at[~hit]
            c = self.last[at]
            rows[live] = self.below[c] + self.tree.rank(c, at)
            steps[live] += 1
        return found
