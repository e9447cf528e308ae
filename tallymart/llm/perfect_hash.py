"""A minimal perfect hash: n distinct 128-bit keys to the numbers 0 to n - 1, in about four bits a key.

Level by level, the keys still left are hashed into a bit array twice their number;
those alone on their place stay there, the others go on to the next level. A key's
number is the count of set bits before its own, which a popcount directory gives.
What comes out depends on the set of keys only, not on their order.
"""

from __future__ import annotations

import numpy as np

from tallymart.llm.words import mixed

LOAD = 2
LEVELS = 60
_STEP = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)
_63, _6 = np.uint64(63), np.uint64(6)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """``sizes``: places of each level, multiples of 64; ``words``: their bits, 64 to a word."""
        self.sizes, self.words = sizes, words
        ends = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.before = np.concatenate(([0], ends))
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.before[-1])

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """From the two halves of distinct keys, as unsigned 64-bit integers."""
        sizes, words, left = [], [np.empty(0, np.uint64)], np.arange(len(high))
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-LOAD * len(left) // 64) * 64
            place = _places(high[left], low[left], len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; for a key that is none, some number or -1."""
        found = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist())):
            place = (_places(high[left], low[left], level, size) + start).astype(np.uint64)
            word = self.words[(place >> _6).astype(np.int64)]
            bit = np.uint64(1) << (place & _63)
            there = (word & bit) != 0
            smaller = np.bitwise_count(word & (bit - np.uint64(1)))
            found[left[there]] = (self.before[(place >> _6).astype(np.int64)] + smaller)[there]
            left = left[~there]
            if not len(left):
                break
        return found


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = mixed(np.array([level + 1], np.uint64) * _STEP)
    return ((mixed(mixed(low + salt) ^ high) >> _32) * np.uint64(size) >> _32).astype(np.int64)
