"""MinHash signatures: many universal hash functions, their minima, and bands of these."""

from __future__ import annotations

import numpy as np

from tallymart.llm.words import mixed

_CHUNK = 1024


class MinHash:
    """``bands * rows`` functions ``h(x) = (a * x + b mod 2**64) >> 32`` of 32-bit keys.

    With a and b drawn at random this family is strongly universal. The draws follow
    from the seed, so each task builds the same functions.
    """

    def __init__(self, bands: int, rows: int, seed: int):
        self.bands, self.rows = bands, rows
        draws = np.random.Generator(np.random.PCG64(seed))
        size = (bands * rows, 1)
        self.a = draws.integers(0, 2**64, size, np.uint64) | np.uint64(1)
        self.b = draws.integers(0, 2**64, size, np.uint64)
        self.weights = draws.integers(0, 2**64, rows, np.uint64) | np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of each function over a set that is not empty, as 32-bit values."""
        keys = shingles >> np.uint64(32)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(keys), _CHUNK):
            values = self.a * keys[at : at + _CHUNK]
            values += self.b
            np.minimum(least, values.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each band; keys of different bands differ as well."""
        grouped = minima.astype(np.uint64).reshape(self.bands, self.rows)
        key = (grouped * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(
            1, self.bands + 1, dtype=np.uint64
        ) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(mixed(key) + grouped[:, 0]).view(np.int64)
