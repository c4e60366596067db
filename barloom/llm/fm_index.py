"""A compressed full-text index over word sequences: BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """Rank of any symbol in a sequence, in as many bit vectors as symbols have bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        everything = np.arange(symbols)
        self.begin = self._descend(everything, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.begin[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the end of the text sorts first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], (np.diff(key[order]) > 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class PassageIndex:
    """Backward search over passages, with the smallest owner of each suffix interval."""

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray):
        lengths = np.fromiter(map(len, passages), np.int64, len(passages))
        words = np.concatenate(passages)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        m, n = len(passages), len(words) + len(passages)
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        # separators differ, so no suffix is compared beyond its passage
        text[is_end] = np.arange(m)
        text[~is_end] = m + ids
        order = suffix_order(text)
        symbol = np.where(is_end, 0, text - m + 1)
        self.n = n
        self.bwt = WaveletMatrix(symbol[order - 1], len(self.vocabulary) + 1)
        counts = np.bincount(symbol, minlength=len(self.vocabulary) + 1)
        self.first = np.cumsum(counts) - counts
        owner = np.repeat(owners, lengths + 1)[order].astype(np.int32)
        self.smallest = [owner]
        width = 1
        while 2 * width <= n:
            last = self.smallest[-1]
            self.smallest.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 where the index has no such word."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol on their left."""
        known = symbol > 0
        s = np.where(known, symbol, 0)
        both = self.bwt.rank(np.concatenate([s, s]), np.concatenate([lo, hi]))
        lo, hi = self.first[s] + both[: len(s)], self.first[s] + both[len(s) :]
        return np.where(known, lo, 0), np.where(known, hi, 0)

    def owner_of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in each interval; beyond all owners where it is empty."""
        out = np.full(len(lo), np.iinfo(np.int32).max, np.int64)
        some = np.flatnonzero(hi > lo)
        level = np.frexp((hi - lo)[some].astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = some[level == k]
            row = self.smallest[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out

    def first_repeat(self, passages: list[np.ndarray], owners: np.ndarray, width: int) -> np.ndarray:
        """Start of the first window of ``width`` words that a smaller owner has, or -1.

        All passages advance together.  Each window is searched from its right
        end; where the match ends before the window does, no window up to that
        place can match, so the next one begins behind it.
        """
        lengths = np.fromiter(map(len, passages), np.int64, len(passages))
        base = np.cumsum(lengths) - lengths
        flat = self.symbols(np.concatenate(passages))
        result = np.full(len(passages), -1, np.int64)
        at = np.flatnonzero(lengths >= width)
        start = np.zeros(len(at), np.int64)
        place = start + width - 1
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        while len(at):
            lo, hi = self.extend(flat[base[at] + place], lo, hi)
            good = self.owner_of(lo, hi) < owners[at]
            done = good & (place == start)
            result[at[done]] = start[done]
            start = np.where(good, start, place + 1)
            place = np.where(good, place - 1, start + width - 1)
            lo, hi = np.where(good, lo, 0), np.where(good, hi, self.n)
            go = ~done & (start + width <= lengths[at])
            at, start, place, lo, hi = at[go], start[go], place[go], lo[go], hi[go]
        return result
