"""Token counts of a BPE vocabulary of pieces, without building the tokens.

Rank-synchronous merging: all new words of a batch lie behind one another in one
array of symbols. In each round every sequence applies its lowest-ranked pair, all
sequences at once, by numpy; a sequence without a mergeable pair leaves with its
number of symbols. Counts of words are remembered, so a round's arrays hold new
words only. A map over rows: no shuffle, one pass over the texts.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_file

from tallymart.llm.bpe import vocabulary
from tallymart.llm.chunks import Remembered

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_TEXT_AT_ONCE = 1 << 20
_LONG = 256
_GONE = -9
_NEVER = np.iinfo(np.int32).max
_LOADED: dict[bytes, PieceCounts] = {}


class PieceCounts:
    """The merges of a ``.model`` file with byte fallback and an identity normalizer."""

    def __init__(self, content: bytes):
        spec = model_file.ModelProto.FromString(content)
        _require_plain(spec)
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        self._symbols(pieces)
        self._pairs(pieces)
        joined = {a + b for p in pieces for a, b in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in joined):
            raise ValueError("a piece has a space behind another character; words can't be told apart")
        self.bigrams = np.sort(
            np.array([ord(a) << 32 | ord(b) for a, b in joined], np.int64)
        )
        inside = {c for pair in joined for c in pair}
        breaks = "".join(c for c in "\n\t\r" if c not in inside)
        self.words = re.compile(f"[{breaks}]|{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache = Remembered()

    @staticmethod
    def load(content: bytes) -> PieceCounts:
        key = hashlib.sha256(content).digest()
        if key not in _LOADED:
            _LOADED[key] = PieceCounts(content)
        return _LOADED[key]

    def _symbols(self, pieces: dict[str, float]) -> None:
        """Numbers for pieces and for characters inside pieces; what each symbol left over counts."""
        letters = {c for p in pieces for c in p} - pieces.keys()
        self.number = {p: i for i, p in enumerate([*pieces, *sorted(letters)])}
        self.cost = np.array(
            [1 if s in pieces else len(s.encode()) for s in self.number], np.int64
        )
        self.letter = -np.ones(0x110000, np.int32)
        self.letter[0x80:] = -2
        self.letter[0x800:] = -3
        self.letter[0x10000:] = -4
        for symbol, i in self.number.items():
            if len(symbol) == 1:
                self.letter[ord(symbol)] = i

    def _pairs(self, pieces: dict[str, float]) -> None:
        """Each pair of symbols that joins to a piece, with the piece and its rank.

        Equal scores share a rank. A piece is ``calm`` if each piece that it can
        become part of ranks behind it: then all its places in a sequence may merge
        in one round, since no merge among them brings a lower rank.
        """
        ranks = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {p: ranks[s] for p, s in pieces.items()}
        calm = np.ones(len(self.number), bool)
        keys, joined, order = [], [], []
        for piece in pieces:
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if left in self.number and right in self.number:
                    keys.append(self.number[left] << 32 | self.number[right])
                    joined.append(self.number[piece])
                    order.append(rank[piece])
                    for part in (left, right):
                        if part in pieces and rank[part] >= rank[piece]:
                            calm[self.number[part]] = False
        by = np.argsort(np.array(keys, np.int64))
        self.pair = np.array(keys, np.int64)[by]
        self.joined = np.array(joined, np.int32)[by]
        self.rank = np.array(order, np.int32)[by]
        self.calm = calm

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols; ``_NEVER`` for pairs that do not join."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        hit = (self.pair[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], _NEVER), np.where(hit, self.joined[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word."""
        total = np.zeros(len(words), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return total
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self.letter[points]
        same = owner[1:] == owner[:-1]
        bigram = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.bigrams, bigram), len(self.bigrams) - 1)
        # a border whose two characters stand side by side in no piece is never merged across
        same &= self.bigrams[at] == bigram
        sequence = np.concatenate(([0], np.cumsum(~same)))
        rank = np.full(len(symbols), _NEVER, np.int32)
        piece = np.full(len(symbols), -1, np.int32)
        inner = np.flatnonzero(same)
        rank[inner], piece[inner] = self._found(symbols[inner], symbols[inner + 1])
        sizes = np.bincount(sequence)
        for at in np.flatnonzero(sizes > _LONG):
            here = slice(sizes[:at].sum(), sizes[: at + 1].sum())
            total[owner[here.start]] += self._one_by_one(symbols[here].tolist())
        short = np.repeat(sizes <= _LONG, sizes)
        symbols, owner, sequence = symbols[short], owner[short], sequence[short]
        rank, piece = rank[short], piece[short]
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            done = np.repeat(least == _NEVER, sizes)
            if done.any():
                left = symbols[done]
                cost = np.where(left >= 0, self.cost[np.maximum(left, 0)], -left)
                total += np.bincount(owner[done], cost, len(words)).astype(np.int64)
                going = ~done
                symbols, owner, sequence = symbols[going], owner[going], sequence[going]
                rank, piece = rank[going], piece[going]
                least, sizes = least[least != _NEVER], sizes[least != _NEVER]
                if not len(symbols):
                    break
            places = self._places(rank == np.repeat(least, sizes), piece, sequence)
            symbols[places] = piece[places]
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            merged = np.zeros(len(symbols), bool)
            merged[places] = True
            symbols, owner, sequence = symbols[stays], owner[stays], sequence[stays]
            rank, piece, merged = rank[stays], piece[stays], merged[stays]
            anew = np.flatnonzero(merged | np.append(merged[1:], False))
            anew = anew[anew < len(symbols)]
            rank[anew], piece[anew] = _NEVER, -1
            inner = anew[anew + 1 < len(symbols)]
            inner = inner[sequence[inner] == sequence[inner + 1]]
            rank[inner], piece[inner] = self._found(symbols[inner], symbols[inner + 1])
        return total

    def _one_by_one(self, symbols: list[int]) -> int:
        """The count of one long sequence, whose rounds would each pass over all of it."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(place: int) -> None:
            if 0 <= place and (follower := after[place]) < n:
                left, right = symbols[place], symbols[follower]
                found = self._pair_of(left, right)
                if found is not None:
                    heapq.heappush(heap, (found[0], place, left, right, found[1]))

        for place in range(n - 1):
            offer(place)
        while heap:
            _, place, left, right, piece = heapq.heappop(heap)
            follower = after[place]
            if follower >= n or symbols[place] != left or symbols[follower] != right:
                continue
            symbols[place], symbols[follower] = piece, _GONE
            after[place] = after[follower]
            if after[place] < n:
                before[after[place]] = place
            offer(place)
            offer(before[place])
        return sum(int(self.cost[s]) if s >= 0 else -s for s in symbols if s != _GONE)

    def _pair_of(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and piece of one pair, or None."""
        if left < 0 or right < 0:
            return None
        wanted = left << 32 | right
        at = bisect.bisect_left(self.pair, wanted)
        if at == len(self.pair) or self.pair[at] != wanted:
            return None
        return int(self.rank[at]), int(self.joined[at])

    def _places(self, lowest: np.ndarray, piece: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Where to merge in this round: the leftmost lowest pair, and of calm pieces all from the left."""
        places = np.flatnonzero(lowest)
        leading = np.concatenate(([True], sequence[places][1:] != sequence[places][:-1]))
        run = np.concatenate(([True], (places[1:] != places[:-1] + 1)))
        run |= leading
        starts = np.flatnonzero(run)
        inside = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
        group = np.cumsum(leading) - 1
        unquiet = np.bincount(group, ~self.calm[piece[places]]) > 0
        return places[np.where(unquiet[group], leading, inside % 2 == 0)]

    def of(self, texts: pa.Array) -> Iterator[int]:
        waiting, size = [], 0
        for text in texts.to_pylist():
            waiting.append(self.words.findall(self.prefix + text.replace(" ", SPACE)) if text else [])
            size += len(text or "")
            if size >= _TEXT_AT_ONCE:
                yield from self._of(waiting)
                waiting, size = [], 0
        yield from self._of(waiting)

    def _of(self, documents: list[list[str]]) -> Iterator[int]:
        with self.cache.filled(documents, lambda new: self.count(new).tolist()):
            for words in documents:
                yield sum(map(self.cache.__getitem__, words))


def _require_plain(spec) -> None:
    """Refuse models with settings this counter does not follow, instead of counting wrongly."""
    cut, train = spec.normalizer_spec, spec.trainer_spec
    odd = [
        train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix,
        bool(cut.precompiled_charsmap) or cut.remove_extra_whitespaces or not cut.escape_whitespaces,
        any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in spec.pieces),
    ]
    if any(odd):
        raise ValueError("only BPE models with byte fallback and an identity normalizer are supported")


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for each row, without begin and end tokens.

    ``path`` is a ``.model`` file on the driver. A null text counts as empty; an
    empty text has no bytes and no tokens. Strings that look like special tokens
    are text. Rows are independent: repeated and null keys give a row each. Other
    columns of the input are not read.
    """
    content = vocabulary(df.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts.load(content.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts.of(batch.column(2)), pa.int64())],
                names=[key, "n_bytes", "n_tokens"],
            )

    schema = T.StructType(
        [df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return df.select(key, size.alias("n_bytes"), text).mapInArrow(count, schema)
