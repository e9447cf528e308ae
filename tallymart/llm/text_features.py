"""Hashed word n-grams of a text as indices into a weight vector.

Words are runs of letters and digits, or of other characters that are not white
space. The n-grams of a text are its words, its pairs of neighbouring words, and
the same two of the words' shapes (case and length for letters, digits, or the
characters themselves). A pair of equal words is one n-gram of its own whatever
the word, so repetition is a feature also where the words are new.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tallymart.llm.chunks import Remembered
from tallymart.llm.words import mixed

_WORD = re.compile(r"\w+|[^\w\s]+")
_KINDS = np.array([1, 2, 3, 4], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SHAPES = 1 << 16


class NGrams:
    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = Remembered(_word)

    def of(self, text: str | None) -> np.ndarray:
        """The index of each n-gram of a text, repetitions included; a null text has none."""
        found = _WORD.findall(text or "")
        codes = np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))
        shapes = codes & np.uint64(_SHAPES - 1)
        parts = [mixed(codes + _KINDS[0]), mixed(shapes + _KINDS[1])]
        if len(codes) > 1:
            same = codes[1:] == codes[:-1]
            pairs = np.where(same, np.uint64(1), codes[:-1] * np.uint64(3) + codes[1:])
            parts += [mixed(pairs + _KINDS[2]), mixed(shapes[:-1] * np.uint64(_SHAPES) + shapes[1:] + _KINDS[3])]
        return (np.concatenate(parts) & self.mask).astype(np.int64)


def _word(word: str) -> int:
    """48 bits of the word in lower case and 16 bits of its shape."""
    if word[0].isalnum() or word[0] == "_":
        case = "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "L"
        shape = f"{'D' if word.isdigit() else case}{min(len(word), 12) // 3}"
    else:
        shape = word[:4]
    low = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) & (_SHAPES - 1)
    return xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & ~(_SHAPES - 1) | low
