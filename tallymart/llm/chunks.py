"""Cutting text where no tokenizer of the byte-level kind can join, and remembering what pieces become."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A run of white space with the run of other characters behind it. Every token pattern of
#: this kind starts a token where white space follows something else, and none looks back,
#: so each chunk has the same tokens alone as within its text.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

GENERATION = 400_000
LONGEST_KEPT = 64
PART_BYTES = 1 << 21


def in_parts(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``PART_BYTES`` of the column ``texts``, one row at least.

    What a task holds besides the batch then depends on neither its rows nor their mean length.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + PART_BYTES, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


class Remembered(dict):
    """Results by piece, in two generations of at most ``generation`` pieces.

    A full young generation becomes the old one; what is found there moves up
    again. Pieces that are forgotten, and long ones, which are never kept, only
    cost time.
    """

    def __init__(self, compute: Callable | None = None, generation: int = GENERATION):
        super().__init__()
        self.compute = compute
        self.generation = generation
        self.old: dict = {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= LONGEST_KEPT:
            self.turn()
            self[piece] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.generation:
            self.old = dict(self)
            self.clear()

    @contextmanager
    def filled(self, documents: list[list[str]], compute: Callable[[list[str]], Iterable]) -> Iterator[None]:
        """For the time of the block, every piece of the documents has its result here."""
        self.turn()
        new = []
        for piece in set(chain.from_iterable(documents)).difference(self):
            value = self.old.get(piece)
            if value is None:
                new.append(piece)
            else:
                self[piece] = value
        self.update(zip(new, compute(new)))
        yield
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self[piece]


def taken(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` one behind the other, and the end of each, with a 0 before the first."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends


class Numbered(defaultdict):
    """Ids by piece, in two generations like :class:`Remembered`: a number for each piece, and one array of all ids.

    A piece of a text costs one look-up, of its number; ids are then gathered for all texts at once.
    """

    def __init__(self, kind: np.dtype | str, generation: int = GENERATION):
        super().__init__()
        self.kind = np.dtype(kind)
        self.generation = generation
        self.old: dict[str, int] = {}
        self.old_ids, self.old_ends = np.empty(0, self.kind), np.zeros(1, np.int64)
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.ids, self.ends = np.empty(0, self.kind), np.zeros(1, np.int64)

    def ids_of(
        self,
        documents: Iterable[list[str]],
        compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
    ) -> Iterator[np.ndarray]:
        """The ids of each document's pieces, one behind the other.

        ``compute`` is asked once, for the pieces that neither generation holds. It
        returns their ids one behind the other and how many each piece has.
        """
        before = len(self)
        try:
            numbered = [list(map(self.__getitem__, pieces)) for pieces in documents]
            new = list(islice(reversed(self), len(self) - before))[::-1]
            self._learn(new, compute)
        except BaseException:
            self._begin()  # pieces that were numbered have no ids
            raise
        sizes = np.fromiter(map(len, numbered), np.int64, len(numbered))
        places = np.fromiter(chain.from_iterable(numbered), np.int64, sizes.sum())
        starts = self.ends[places]
        ids, ends = taken(self.ids, starts, self.ends[places + 1] - starts)
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self[piece]
        if len(self) >= self.generation or len(self.ids) >= LONGEST_KEPT * self.generation:
            self.old = dict(islice(self.items(), max(len(self) - self.generation, 0), None))
            self.old_ids, self.old_ends = self.ids, self.ends
            self._begin()
        first = 0
        for last in ends[np.cumsum(sizes)].tolist():
            yield ids[first:last]
            first = last

    def _learn(self, new: list[str], compute: Callable) -> None:
        if not new:
            return
        asked = [piece for piece in new if piece not in self.old]
        ids, lengths = compute(asked)
        numbers = np.fromiter((self.old.get(piece, -1) for piece in new), np.int64, len(new))
        known = numbers >= 0
        starts, sizes = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        starts[known] = self.old_ends[numbers[known]]
        sizes[known] = self.old_ends[numbers[known] + 1] - starts[known]
        starts[~known] = len(self.old_ids) + np.cumsum(lengths) - lengths
        sizes[~known] = lengths
        found, ends = taken(np.concatenate([self.old_ids, ids.astype(self.kind)]), starts, sizes)
        self.ids, self.ends = (
            np.concatenate([self.ids, found]),
            np.concatenate([self.ends, self.ends[-1] + ends[1:]]),
        )
