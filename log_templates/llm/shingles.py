"""Word shingles of a text as arrays of 64-bit hashes, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 500_000  # words whose hash a task remembers; beyond it the cache starts anew

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words.

    A-Z count as a-z; words are cut at ``[\\x20\\x09-\\x0D]``.  A text of fewer words
    is one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = min(size, len(words))
    count = len(each) - n + 1
    rolled = np.full(count, n, np.uint64)
    for k in range(n):
        rolled = mix64(rolled * _A + each[k : k + count])
    return np.unique(rolled)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values that two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
