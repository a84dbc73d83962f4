"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; a shorter text is one run; no words, no runs."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + len(out)] * _ODD[i % 5] + np.uint64(i + 1))
    return out


def shingle_set(words: list[bytes], known: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(grams(word_hashes(words, known), n))
