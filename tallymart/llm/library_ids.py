"""Ids of texts as the tokenizers library gives them, from a vocabulary file's content.

The library is asked once for each new pre-token of the texts (see :meth:`ByteBPE.cut`);
what it answered is remembered. New ones of a batch that begin with a space go to it in one
call, joined: it cuts there itself, so the ids are told apart by their byte lengths.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallymart.llm.bpe import ByteBPE
from tallymart.llm.chunks import Numbered, taken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

_TEXT_AT_ONCE = 1 << 20
_LOADED: dict[bytes, LibraryIds] = {}


class LibraryIds:
    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        bpe = ByteBPE(content)
        self.cut = bpe.cut
        #: Joined words could make a special token that holds a space.
        self.joins = not any(" " in token for token in bpe.special)
        known = bpe.bytes_of
        self.top = max(known)
        self.lengths = np.zeros(self.top + 1, np.int64)
        for i, token in known.items():
            self.lengths[i] = len(token)
        self.words = Numbered("<u4")

    @staticmethod
    def load(content: bytes) -> LibraryIds:
        """The vocabulary, built once in each Python worker."""
        key = hashlib.sha256(content).digest()
        if key not in _LOADED:
            _LOADED[key] = LibraryIds(content)
        return _LOADED[key]

    def kind_with(self, end_id: int) -> np.dtype:
        """The narrowest of the unsigned 16- and 32-bit types that holds every id."""
        return np.dtype("<u2" if max(self.top, end_id) < 1 << 16 else "<u4")

    def packed(self, texts: pa.Array, kind: np.dtype) -> Iterator[bytes]:
        """The ids of each text as bytes of the given type, in order."""
        if kind != self.words.kind:
            self.words = Numbered(kind)
        waiting, size = [], 0
        for text in texts.to_pylist():
            text = text or ""
            waiting.append(text)
            size += len(text)
            if size >= _TEXT_AT_ONCE:
                yield from self._packed(waiting)
                waiting, size = [], 0
        yield from self._packed(waiting)

    def _packed(self, texts: list[str]) -> Iterator[bytes]:
        return (ids.tobytes() for ids in self.words.ids_of(map(self.cut, texts), self._of))

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words, and how many each has; those that begin with a space go in one call."""
        joined, single = [], []
        for at, word in enumerate(words):
            (joined if self.joins and word[0] == " " and not word.isspace() else single).append(at)
        ids, lengths = self._split([words[at] for at in joined])
        found, sizes = [ids], [lengths]
        for first in range(0, len(single), 4096):
            part = [words[at] for at in single[first : first + 4096]]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            found += [np.array(i, np.int64) for i in encoded]
            sizes.append(np.array([len(i) for i in encoded], np.int64))
        order, lengths = np.array(joined + single, np.int64), np.concatenate(sizes)
        starts, every = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths) - lengths
        every[order] = lengths
        return taken(np.concatenate(found), starts, every)[0], every

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        text = "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        cuts = np.searchsorted(ends, wanted) + 1
        if cuts[-1] != len(ids) or not np.array_equal(ends[cuts - 1], wanted):
            raise RuntimeError("a token crosses the border of two words")
        return ids, np.diff(cuts, prepend=0)
