"""A compressed FM-index over integers: wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the end of the text sorts before everything."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n or k >= n:
            return order


class _Bits:
    """A bit string with rank: words of 64 bits and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int64)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        self.shifts = list(range(max(int(top).bit_length(), 1) - 1, -1, -1))
        for shift in self.shifts:
            bits = (values >> shift) & 1
            self.levels.append(_Bits(bits.astype(np.uint8)))
            values = np.concatenate((values[bits == 0], values[bits == 1]))

        self.first = self._path(np.arange(int(top) + 1), [np.zeros(int(top) + 1, np.int64)])[0]

    def _path(self, symbol: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        at = list(at)
        for level, shift in zip(self.levels, self.shifts, strict=True):
            one = ((symbol >> shift) & 1).astype(bool)
            for k, i in enumerate(at):
                ones = level.ones(i)
                at[k] = np.where(one, level.zeros + ones, i - ones)
        return at

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each end."""
        first = self.first[symbol]
        return [e - first for e in self._path(symbol, list(ends))]


class RangeMin:
    """Least value in a range, by blocks of 16 and a table over their minima."""

    SIZE = 16

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // self.SIZE) * self.SIZE
        self.values = np.full(n + self.SIZE, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        self.table = [self.values.reshape(-1, self.SIZE).min(1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over values[lo:hi], for hi > lo."""
        reach = np.arange(self.SIZE)
        head, tail = lo[:, None] + reach, hi[:, None] - 1 - reach
        out = np.minimum(
            np.where(head < hi[:, None], self.values[head], np.iinfo(np.int32).max).min(1),
            np.where(tail >= lo[:, None], self.values[tail], np.iinfo(np.int32).max).min(1),
        )
        first, last = lo // self.SIZE + 1, hi // self.SIZE  # whole blocks inside
        wide = np.flatnonzero(last > first)
        if len(wide):
            a, b = first[wide], last[wide]
            level = np.frexp((b - a).astype(float))[1] - 1
            for k in np.unique(level):
                own = level == k
                t = self.table[k]
                out[wide[own]] = np.minimum(out[wide[own]], np.minimum(t[a[own]], t[b[own] - (1 << k)]))
        return out


class FMIndex:
    """Index of segments (runs of positive integers), each with an owner; answers which stretches smaller owners hold."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray):
        sizes = np.array([len(s) for s in segments])
        self.text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes
        for s, at in zip(segments, self.starts, strict=True):
            self.text[at : at + len(s)] = s
        self.sizes = sizes
        sa = suffix_array(self.text)
        top = int(self.text.max())
        self.bwt = WaveletMatrix(self.text[sa - 1], top)
        self.before = np.append(0, np.cumsum(np.bincount(self.text, minlength=top + 1)))
        self.rank_of = np.unique(owners, return_inverse=True)[1].astype(np.int32)
        owner_at = np.repeat(np.append(self.rank_of, np.iinfo(np.int32).max), np.append(sizes + 1, 1))
        self.least = RangeMin(np.append(np.iinfo(np.int32).max, owner_at[:-1])[sa])

    def _one(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of the last symbol before each end alone, which need no search."""
        symbol = self.text[end - 1]
        return end - 1, self.before[symbol], self.before[symbol + 1]

    def _extended(self, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of backward search: whether the match goes on to the left in a segment of a smaller owner, and its new range."""
        symbol = self.text[np.maximum(left - 1, 0)]
        a, b = self.bwt.rank(symbol, lo, hi)
        a, b = a + self.before[symbol], b + self.before[symbol]
        fits = (left > first) & (b > a)
        at = np.flatnonzero(fits)
        fits[at] = self.least.least(a[at], b[at]) < own[at]
        return fits, a, b

    def _regions(self, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, end) of the parts of segments that a match of least_length can lie in.

        Such a match holds a whole block of half its length, counted from the segment's start, and all blocks that it holds occur in a segment of
        a smaller owner. Most other blocks fail after a few steps. A region is a run of blocks that occur, with what may stand beside it."""
        size = max((least_length + 1) // 2, 1)
        n = self.sizes // size
        segment = np.repeat(np.flatnonzero(n), n[n > 0])
        number = np.arange(len(segment)) - np.repeat(np.cumsum(n[n > 0]) - n[n > 0], n[n > 0])
        start = self.starts[segment] + number * size
        block, left_of, own = np.arange(len(segment)), start, self.rank_of[segment]
        left, lo, hi = self._one(start + size)
        while len(block) and (left > left_of).any():
            fits, a, b = self._extended(left, lo, hi, left_of, own)
            block, left_of, own, left, lo, hi = block[fits], left_of[fits], own[fits], left[fits] - 1, a[fits], b[fits]
        if not len(block):
            return block, block, block
        new = np.append(True, (block[1:] != block[:-1] + 1) | (segment[block[1:]] != segment[block[:-1]]))
        head, tail = block[new], block[np.append(np.flatnonzero(new)[1:] - 1, len(block) - 1)]
        of, first = segment[head], self.starts[segment[head]]
        return of, np.maximum(first, start[head] - size + 1), np.minimum(first + self.sizes[of], start[tail] + 2 * size - 1)

    def held_by_smaller(self, least_length: int) -> list[list[tuple[int, int]]]:
        """For each segment its maximal stretches of least_length or more that occur in a segment of a smaller owner.

        Each region is streamed against the index from its right end: backward search extends the match to the left
        while a smaller owner holds it (its matching statistic), then goes on from the next end that can give more.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(self.sizes))]
        lane, first, end = self._regions(least_length)
        wide = end - first >= least_length
        lane, first, end = lane[wide], first[wide], end[wide]
        own, base = self.rank_of[lane], self.starts[lane]
        left, lo, hi = self._one(end)
        while len(lane):
            fits, a, b = self._extended(left, lo, hi, first, own)
            lo[fits], hi[fits] = a[fits], b[fits]
            left[fits] -= 1
            stop = ~fits
            report = np.flatnonzero(stop & (end - left >= least_length))
            for i in report.tolist():
                found[lane[i]].append((int(left[i] - base[i]), int(end[i] - base[i])))
            # what could be new starts further left and so ends before
            end = np.where(stop, np.where(end - left >= least_length, left - 1 + least_length, end - 1), end)
            go = ~(stop & (end - first < least_length))
            at = np.flatnonzero(stop & go)
            left[at], lo[at], hi[at] = self._one(end[at])
            if not go.all():
                lane, first, own, base, end, left, lo, hi = (x[go] for x in (lane, first, own, base, end, left, lo, hi))
        return found
