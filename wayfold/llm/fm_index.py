"""A compressed FM-index over word sequences: wavelet matrix with packed bits, vectorised backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words, with a count before each word: rank in constant time for many places at once."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))[:-1].astype(np.int32)
        self.ones = int(bits.sum())
        self.zeros = len(bits) - self.ones

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """rank(symbol, place): how often the symbol stands before the place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        self.depth = max(1, int(sigma - 1).bit_length())
        now = symbols.astype(np.int64)
        for k in reversed(range(self.depth)):
            bits = (now >> k & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            now = np.concatenate((now[bits == 0], now[bits == 1]))

        # Where each symbol's block begins below the last level: a symbol's path doesn't depend on the place.
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            ones = bits.rank1(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of a text whose suffixes all differ before they end, by prefix doubling.

    Also, for each place, the interval of the suffixes that agree with its own in the first `depth` symbols (a power of
    two): suffixes that agree stand together in every later order. A suffix goes by the place where its group begins;
    groups of one are not sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    key, step, low, high = text[order], 1, None, None
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(slots)))
        # Slots of a group follow each other, so the first one's number is where the group begins.
        rank[order[slots]] = np.repeat(slots[begin], sizes)
        if step == depth:
            low = rank.copy()
            high = low + np.bincount(rank, minlength=n)[rank]
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            if low is None:
                low, high = rank, rank + 1
            return order, low, high
        some = order[slots]
        key = rank[some] * (n + 1)
        inside = some + step < n
        key[inside] += rank[some[inside] + step] + 1
        by = np.argsort(key, kind="stable")
        order[slots], key = some[by], key[by]
        step *= 2


class FMIndex:
    """Of many word sequences. Each is closed by a mark of its own, so no match runs from one into the next.

    A sequence may stand for several copies: occurrences are counted with its weight, so copies are indexed once. The
    intervals of all runs of SEED words that start in the index are kept from the suffix order; searches begin with them.
    """

    SEED = 8

    def __init__(self, words: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None):
        sizes = np.diff(offsets)
        n_seq = len(sizes)
        self.alphabet, code = np.unique(words, return_inverse=True)
        text = np.empty(len(words) + n_seq, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[ends] = np.arange(n_seq)
        text[inner] = code + n_seq
        self.n_seq, self.n, self.code = n_seq, len(text), code + n_seq
        sigma = n_seq + len(self.alphabet)
        weights = np.ones(n_seq, np.int64) if weights is None else weights.astype(np.int64)
        self.before = np.zeros(1, np.int64)
        if self.n:
            order, low, high = suffix_order(text, self.SEED)
            self.low, self.high = low[inner], high[inner]
            self.before = np.concatenate(([0], np.cumsum(np.repeat(weights, sizes + 1)[order])))
        self.bwt = WaveletMatrix(text[order - 1], max(sigma, 2)) if self.n else None
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))) if self.n else np.zeros(1, np.int64)

    def intervals(self, offsets: np.ndarray, longest: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the indexed sequences (offsets: words of each) hold `longest` words in a row that occur `least` times or
        more: sequence, first word, and number of such windows, a row per interval of neighbouring windows.

        Windows with a rarer run of SEED words are out at once. What remains is streamed from the right: from the last
        window's end backward search goes on as long as there are `least` occurrences. Such a match settles all windows
        within it, and the search begins anew at the last window that it doesn't hold. All stretches search side by side.
        """
        n_win = np.maximum(np.diff(offsets) - longest + 1, 0)
        none = np.zeros(0, np.int64)
        if not n_win.sum():
            return none, none, none
        often = np.concatenate(([0], np.cumsum(self.before[self.high] - self.before[self.low] >= least)))
        seq = np.repeat(np.arange(len(n_win)), n_win)
        start = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + np.repeat(offsets[:-1], n_win)
        need = longest - self.SEED + 1
        keep = often[start + need] - often[start] == need
        seq, start = seq[keep], start[keep]
        if not len(seq):
            return none, none, none
        new = np.concatenate(([True], (seq[1:] != seq[:-1]) | (start[1:] != start[:-1] + 1)))
        begin = np.flatnonzero(new)
        of, left = seq[begin], start[begin]
        right = start[np.append(begin[1:], len(seq)) - 1].copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(of))
        while len(live):
            reached = self._backward(right[live] + longest, left[live], least)
            hit = right[live] + longest - reached >= longest
            found.append((of[live[hit]], reached[hit], right[live[hit]] - reached[hit] + 1))
            right[live] = np.where(hit, reached, right[live]) - 1
            live = live[right[live] >= left[live]]
        seq, start, n = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.argsort(start, kind="stable")
        seq, start, n = seq[by], start[by], n[by]
        new = np.concatenate(([True], (seq[1:] != seq[:-1]) | (start[1:] != start[:-1] + n[:-1]))) if len(seq) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        return seq[begin], start[begin], np.add.reduceat(n, begin) if len(begin) else none

    def _backward(self, ends: np.ndarray, stops: np.ndarray, least: int) -> np.ndarray:
        """Where the longest match that ends before each place of the indexed words begins, not before its stop."""
        reached = ends - self.SEED
        low, high = self.low[reached], self.high[reached]
        live = np.flatnonzero((reached > stops) & (self.before[high] - self.before[low] >= least))
        low, high = low[live], high[live]
        while len(live):
            symbol = self.code[reached[live] - 1]
            both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            first = self.first[symbol]
            low, high = first + both[: len(live)], first + both[len(live) :]
            ok = self.before[high] - self.before[low] >= least
            live, low, high = live[ok], low[ok], high[ok]
            reached[live] -= 1
            ok = reached[live] > stops[live]
            live, low, high = live[ok], low[ok], high[ok]
        return reached
