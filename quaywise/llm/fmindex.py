"""A compressed FM-index over integer symbols: backward search on an entropy-shaped wavelet tree, for many queries at once.

Matches are capped at ``depth`` symbols, so suffixes need be sorted by their first ``depth`` symbols only. An index
serves one shard inside a task; Spark decides what a shard holds (see ``substring``).
"""

from __future__ import annotations

import numpy as np

#: Ones below each place of a word of 64 bits.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """Occurrences of a symbol before a position. A symbol of frequency f among n has a code of ceil(log2(n / f)) bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        freq = np.bincount(seq, minlength=sigma)
        length = np.zeros(sigma, np.int64)
        there = freq > 0
        length[there] = np.maximum(1, np.ceil(np.log2(n / freq[there])).astype(np.int64))
        self.levels = int(length.max(initial=0))
        by_length = np.lexsort((np.arange(sigma), np.where(there, length, 1 << 20)))[: int(there.sum())]
        step = np.int64(1) << (self.levels - length[by_length])
        code = np.zeros(sigma, np.int64)
        code[by_length] = np.cumsum(step) - step  # canonical: short codes first, aligned to the left
        self.length, self.code = length, code
        self.start = np.zeros((self.levels + 1, sigma), np.int64)
        self.before = np.zeros((self.levels, sigma), np.int64)
        self.words, self.ones = [], []
        for level in range(1, self.levels):
            prefix = code[by_length] >> (self.levels - level)
            held = np.where(length[by_length] > level, freq[by_length], 0)
            node = np.cumsum(held) - held
            self.start[level, by_length] = node[np.searchsorted(prefix, prefix, "left")]
        for level in range(self.levels):
            bits = (code[seq] >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bits.astype(bool), bitorder="little")
            word = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(word)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64))).astype(np.int32))
            total = np.concatenate(([0], np.cumsum(bits)))
            self.before[level] = total[np.minimum(self.start[level], len(seq))]
            if level + 1 < self.levels:
                go = np.flatnonzero(length[seq] > level + 1)
                own, bit = seq[go], bits[go]
                nth = total[go] - self.before[level, own]
                nth = np.where(bit == 1, nth, go - self.start[level, own] - nth)
                # symbols whose codes end here share no child with those that go on, so places stay gapless
                out = np.empty(len(go), seq.dtype)
                out[self.start[level + 1, own] + nth] = own
                seq = out
        self._packed()

    def _packed(self) -> None:
        """Positions of a shard fit 32 bits; lengths of codes, longest first, fit a byte."""
        self.start, self.before = self.start.astype(np.int32), self.before.astype(np.int32)
        self.shorter = (self.levels - self.length).astype(np.int8)
        self.shorter_than = (self.levels - np.arange(1, self.levels + 1)).astype(np.int8)

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the number of ``symbol`` among the first ``lo`` and the first ``hi`` symbols; symbols must occur.

        Queries are put in order of code length, so those that go on at a level are always the first ones.
        """
        less = self.shorter[symbol]
        order = np.argsort(less, kind="stable")  # of bytes: a counting sort
        n, c = len(symbol), symbol[order]
        at = np.concatenate((lo[order], hi[order])).astype(np.int32)
        going = np.searchsorted(less[order], self.shorter_than, "right")
        code = self.code[c]
        for level in range(self.levels):
            m = going[level]
            if not m:
                break
            start, before = self.start[level][c[:m]], self.before[level][c[:m]]
            bit = ((code[:m] >> (self.levels - 1 - level)) & 1).astype(bool)
            words, total = self.words[level], self.ones[level]
            for x in (at[:m], at[n : n + m]):
                p = start + x
                w = p >> 6
                ones = total[w] + np.bitwise_count(words[w] & _BELOW[p & 63]) - before
                x[:] = np.where(bit, ones, x - ones)
        out = np.empty((2, n), np.int64)
        out[0, order], out[1, order] = at[:n], at[n:]
        return out[0], out[1]


class FMIndex:
    """Index of ``text`` (symbols from 1; 0 separates its pieces and ends it). Row r stands for the r-th suffix in order."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        self.symbols = np.unique(text)
        ids = np.searchsorted(self.symbols, text)
        ranks, h = {1: ids}, 1

        def pairs(rank: np.ndarray, shift: int) -> np.ndarray:
            later = np.concatenate((rank[shift:], np.zeros(min(shift, n), np.int64)))[:n]
            return rank * (int(rank.max(initial=0)) + 1) + later

        while h * 2 <= depth:
            key = pairs(ranks[h], h)
            order = np.argsort(key)
            fresh = np.concatenate(([0], np.diff(key[order]) != 0)).cumsum()
            ranks[h * 2] = np.empty(n, np.int64)
            ranks[h * 2][order] = fresh
            h *= 2
        key = pairs(ranks[h], depth - h) if depth > h else ranks[h]
        self.rows = np.argsort(key)  # positions in order of their first ``depth`` symbols
        self.lcp = np.zeros(n, np.int64)
        a, b = self.rows[:-1], self.rows[1:]
        for step in sorted(ranks, reverse=True):
            for _ in range(2 if step == h else 1):
                same = np.concatenate((ranks[step], np.full(depth + 1, -1)))
                at = self.lcp[1:]
                at += step * ((at + step <= depth) & (same[a + at] == same[b + at]) & (b + at < n) & (a + at < n))
        count = np.bincount(ids, minlength=len(self.symbols))
        self.less = np.cumsum(count) - count
        self.tree = WaveletTree(ids[self.rows - 1], len(self.symbols))
        self.n = n
        self._edges: dict[int, np.ndarray] = {}

    def widen(self, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first ``depth`` symbols with ``row``: first, and one past the last."""
        if depth not in self._edges:
            edge = np.flatnonzero(self.lcp < depth)
            self._edges[depth] = np.append(edge, self.n)
        edge = self._edges[depth]
        k = np.searchsorted(edge, row, "right") - 1
        return edge[k], edge[k + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search; an empty interval if the longer pattern doesn't occur. Symbols are dense, -1: none."""
        out_lo, out_hi = np.zeros_like(lo), np.zeros_like(hi)
        known = np.flatnonzero(symbol >= 0)
        s = symbol[known]
        a, b = self.tree.ranks(s, lo[known], hi[known])
        out_lo[known], out_hi[known] = self.less[s] + a, self.less[s] + b
        return out_lo, out_hi

    def matching_statistics(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of the concatenated ``queries`` the longest match that begins there (up to ``depth`` and to the
        query's end), and the first row of its interval.

        All queries run from their ends backwards in step. A match that can't grow falls back to its parent interval
        until it can, as matching statistics over an FM-index do.
        """
        at = np.searchsorted(self.symbols, queries)
        at = np.where(at < len(self.symbols), at, 0)
        dense = np.where((self.symbols[at] == queries) & (queries != 0), at, -1)
        match, row = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        ends = np.cumsum(sizes)
        lo, hi, d = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            todo = np.flatnonzero(sizes >= back)
            full = todo[d[todo] == self.depth]
            lo[full], hi[full] = self.widen(lo[full], self.depth - 1)
            d[full] -= 1
            while len(todo):
                new_lo, new_hi = self.extend(dense[ends[todo] - back], lo[todo], hi[todo])
                ok = new_lo < new_hi
                good, bad = todo[ok], todo[~ok]
                lo[good], hi[good] = new_lo[ok], new_hi[ok]
                d[good] += 1
                bad_end = bad[d[bad] == 0]
                lo[bad_end], hi[bad_end] = 0, self.n
                todo = bad[d[bad] > 0]
                if len(todo):  # the parent: the longest shorter match with more rows
                    left = np.where(lo[todo] > 0, self.lcp[lo[todo]], 0)
                    right = np.where(hi[todo] < self.n, self.lcp[np.minimum(hi[todo], self.n - 1)], 0)
                    parent = np.minimum(np.maximum(left, right), d[todo] - 1)
                    for depth in np.unique(parent):
                        some = todo[parent == depth]
                        lo[some], hi[some] = self.widen(lo[some], int(depth)) if depth else (0, self.n)
                    d[todo] = parent
            now = np.flatnonzero(sizes >= back)
            match[ends[now] - back], row[ends[now] - back] = d[now], lo[now]
        return match, row
