"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Words remembered by one worker; the memory starts anew beyond that.
CACHE_WORDS = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes.lower and bytes.split act on ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, no words are none."""
    w = words(text)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=n)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, n)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s ^= s >> np.uint64(29)
        s *= _MIX
        s += h[i : n - k + 1 + i]
    s ^= s >> np.uint64(32)
    s *= _MIX
    return np.unique(s)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
