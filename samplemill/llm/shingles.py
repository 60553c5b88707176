"""Hashes of five-word shingles, from hashes of words that are kept."""

from __future__ import annotations

import numpy as np
import xxhash

from samplemill.llm.workers import on_change, use_caches

SHINGLE = 5
#: Bytes of words that a Python worker keeps with their hashes (with its entry, a word takes about 150 bytes more).
CACHE = 24 << 20
ENTRY = 150


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


class Shingler:
    """64-bit hashes of all runs of five words; words as elsewhere, with A-Z in lower case."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0

    def words(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        use_caches("shingles")
        if self.held > CACHE:
            self.forget()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
                self.held += len(w) + ENTRY
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        n = len(words) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        return mix(total)


#: One per Python worker.
SHINGLER = Shingler()
on_change("shingles", SHINGLER.forget)
