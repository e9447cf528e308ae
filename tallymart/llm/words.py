"""Words and word shingles as 64-bit hashes, shared by the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(33)


class WordHashes(dict):
    """64-bit hash of each word seen; forgets all words beyond ``CACHED_WORDS``, which only costs time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text: runs without space, tab, LF, VT, FF and CR, A-Z lower-cased.

        ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly these six bytes.
        """
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = (values ^ (values >> _HALF)) * _MIX_1
    values = (values ^ (values >> _HALF)) * _MIX_2
    return values ^ (values >> _HALF)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; of fewer words, the run of all."""
    if not len(words):
        return words
    width = min(width, len(words))
    last = len(words) - width + 1
    value = np.full(last, width, np.uint64)
    for at in range(width):
        value = value * _MULTIPLIER + words[at : at + last]
    return np.unique(mixed(value))
