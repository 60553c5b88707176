"""Byte-pair merges of many words at once, on flat numpy arrays."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np

#: A word of more symbols is merged with a heap: rounds over it would take time with the square of its length.
LONG = 256
NONE = np.int64(1) << 30


class MergeTable:
    """Pairs of symbols that merge: ``(left, right) -> (rank, merged symbol)``; the smallest rank goes first."""

    def __init__(self, pairs: Mapping[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        self.width = 1 + max((max(p) for p in pairs), default=0)
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # A last entry that no pair has keeps every search inside the arrays.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array([*pairs.values()], np.int64).reshape(-1, 2)[order]
        self.ranks, self.merged = np.append(values[:, 0], NONE), np.append(values[:, 1], 0)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        known = (self.keys[at] == key) & (left < self.width) & (right < self.width)
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all words, one word after the other, and how many each word has.

        ``symbols`` and ``sizes`` give the words in the same way. In each round every word that still has a known
        pair merges one: the pair of the smallest rank, the leftmost of equals. All words take part in the same
        round, and the arrays are compacted after it. Words without a known pair leave.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        symbols = symbols.astype(np.int64)
        # Finished symbols with the numbers of their words.
        out = [(word[:0], symbols[:0])]
        for w in np.flatnonzero(sizes > LONG):
            merged = self._long(symbols[word == w])
            out.append((np.full(len(merged), w), merged))
        short = (sizes <= LONG)[word]
        symbols, word = symbols[short], word[short]
        last = np.append(word[1:] != word[:-1], np.ones(min(1, len(word)), bool))
        rank, into = self._find(symbols, np.append(symbols[1:], np.zeros(min(1, len(word)), np.int64)))
        rank[last] = NONE
        while len(symbols):
            starts = np.append(0, np.flatnonzero(last)[:-1] + 1)
            # Rank and position in one number: the minimum is the leftmost pair of the smallest rank.
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            done = best >> 32 == NONE
            at = best[~done] & 0xFFFFFFFF
            gone = np.repeat(done, np.diff(np.append(starts, len(word))))
            out.append((word[gone], symbols[gone]))
            symbols[at] = into[at]
            last[at] = last[at + 1]
            kept = ~gone
            kept[at + 1] = False
            at = np.cumsum(kept)[at] - 1
            symbols, word, rank, into, last = symbols[kept], word[kept], rank[kept], into[kept], last[kept]
            # Only the pairs at the merged symbol are new: the one that it starts and the one that it ends.
            p = np.concatenate([at, at[at > 0] - 1])
            p = p[~last[p]]
            rank[p], into[p] = self._find(symbols[p], symbols[p + 1])
            rank[at[last[at]]] = NONE
        word, symbols = (np.concatenate(x) for x in zip(*out))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges of one word with a heap of its pairs."""
        s = symbols.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if after[i] < n and (found := self.pairs.get((s[i], s[after[i]]))):
                heapq.heappush(heap, (found[0], i, s[i], s[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in s if x >= 0], np.int64)
