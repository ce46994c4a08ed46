"""Words of a text as 64-bit hashes, and hashes of its word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, kept for words seen before (a bounded number); ``strip``: characters that do not
    count at either end of a word."""

    def __init__(self, strip: bytes = b"", most: int = 200_000):
        super().__init__()
        self.strip, self.most = strip, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = (word.strip(self.strip) or word) if self.strip else word
        found = self[word] = xxhash.xxh3_64_intdigest(bare)
        return found

    def __call__(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a UTF-8 text, A-Z lower-cased, split at ASCII white space."""
        words = text.lower().split()  # of bytes: changes and splits at ASCII only
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each window of ``width`` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out *= _FACTOR
        out += words[k : n - width + 1 + k]
    return mix(out + np.uint64(width))
