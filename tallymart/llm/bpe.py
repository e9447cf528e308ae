"""Byte-level BPE encoding and decoding.

The merges of a pre-token run on a segment tree over the ranks of adjacent pairs. Its
root holds the lowest rank and, among equal ranks, the leftmost place, so each merge
costs one look at the root and three point updates of logarithmic depth. A run of
100,000 letters without a space takes about two million steps, not ten billion.
The trees of short new pre-tokens of a batch are numpy rows and take their merges side by side.

Encoding is a map over rows: no shuffle, one pass over the texts, Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from tallymart.llm.chunks import CHUNK, Numbered, Remembered, in_parts, taken

#: Fixed value: the pattern that cuts text into pre-tokens in this family of vocabularies.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: From here on libraries differ in which characters they know as letters, so the
#: vocabulary's own library cuts chunks that hold such a character.
_FIRST_UNSTABLE = "\u0250"
_UNSTABLE = re.compile(f"[{_FIRST_UNSTABLE}-\U0010ffff]")
_PLACE_BITS = 32
_PLACE = (1 << _PLACE_BITS) - 1
_NONE = 1 << 62
_LARGEST_VOCABULARY = 64_000_000
#: Pre-tokens of at most so many bytes are merged side by side, so many at once.
_SHORT, _TREES = 62, 4096
#: Two generations of each are kept. A forgotten word is merged again; a forgotten chunk is only cut again.
WORDS_KEPT, CHUNKS_KEPT = 200_000, 50_000
_LOADED: dict[bytes, ByteBPE] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by letter.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def stable_pre_tokens() -> re.Pattern:
    """``PRE_TOKENS`` for texts without characters from ``_FIRST_UNSTABLE`` on, with its classes spelled out."""
    letters, numbers, spaces = (
        "".join(c for c in map(chr, range(ord(_FIRST_UNSTABLE))) if regex.match(kind, c))
        for kind in (r"\p{L}", r"\p{N}", r"\s")
    )
    return re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


class ByteBPE:
    """A vocabulary with merges, read from the JSON file of the tokenizers library."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        _require_plain(spec)
        model = spec["model"]
        letters = byte_letters()
        vocabulary: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {
            i: bytes(map(letters.__getitem__, token))
            for token, i in vocabulary.items()
            if all(c in letters for c in token)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.id_of_byte = [0] * 256
        for letter, b in letters.items():
            self.id_of_byte[b] = vocabulary[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left] << _PLACE_BITS | vocabulary[right]
            self.rank.setdefault(pair, rank)
            self.merged.append(vocabulary[left + right])
        self._specials = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self._stable_pre_tokens = stable_pre_tokens()
        self._library_cut = ByteLevel(add_prefix_space=False, use_regex=True)
        self._words = Numbered("<u4", WORDS_KEPT)
        self._chunks = Remembered(self._chunk, CHUNKS_KEPT)
        self._byte_ids = np.array(self.id_of_byte, np.int64)
        self._merged_ids = np.array(self.merged, np.int64)
        #: One more than every id: no pair holds it, so it stands for "nothing" beside a pre-token.
        self._beyond = max(self.bytes_of) + 1
        pairs = sorted((self._pair(p >> _PLACE_BITS, p & _PLACE), r) for p, r in self.rank.items())
        self._pairs, self._ranks = np.array([(-1, 0), *pairs], np.int64).T.copy()
        ids = range(self._beyond + 1)
        self._bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in ids), np.uint8)
        self._lengths = np.array([len(self.bytes_of.get(i, b"")) for i in ids], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths

    @staticmethod
    def load(content: bytes) -> ByteBPE:
        """The vocabulary, built once in each Python worker."""
        key = hashlib.sha256(content).digest()
        if key not in _LOADED:
            _LOADED[key] = ByteBPE(content)
        return _LOADED[key]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; the texts' new pre-tokens are merged together."""
        return (ids.tobytes() for ids in self._words.ids_of(map(self.cut, texts), self._merged))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        return next(self.decode_all([ids]))

    def decode_all(self, packed: list[bytes]) -> Iterator[str]:
        """The text of each of some packed ids."""
        ids = np.minimum(np.frombuffer(b"".join(packed), "<u4"), self._beyond)
        found, ends = taken(self._bytes, self._starts[ids], self._lengths[ids])
        raw = found.tobytes()
        documents = np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)
        first = 0
        for last in ends[documents].tolist():
            yield raw[first:last].decode("utf-8", "replace")
            first = last

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens are pre-tokens of their own."""
        parts = self._specials.split(text) if self._specials else [text]
        if len(parts) == 1:
            return self._plain(text)
        words = []
        for at, part in enumerate(parts):
            words += [part] if at % 2 else self._plain(part)
        return words

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not _UNSTABLE.search(text):
            return self._stable_pre_tokens.findall(text)
        words = []
        for chunk in CHUNK.findall(text):
            words += self._chunks[chunk]
        return words

    def _chunk(self, chunk: str) -> list[str]:
        if not _UNSTABLE.search(chunk):
            return self._stable_pre_tokens.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self._library_cut.pre_tokenize_str(chunk)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pre-tokens and how many each has: short ones on trees side by side, others one by one."""
        raw = [word.encode("utf-8") for word in words]
        out: list[bytes] = [b""] * len(words)
        by_depth: dict[int, list[int]] = {}
        for at, word in enumerate(raw):
            if words[at] in self.special:
                out[at] = _packed([self.special[words[at]]])
            elif len(word) > _SHORT:
                out[at] = _packed(self.merge([self.id_of_byte[b] for b in word]))
            else:
                by_depth.setdefault((len(word) + 1).bit_length(), []).append(at)
        for depth, places in by_depth.items():
            for first in range(0, len(places), _TREES):
                part = places[first : first + _TREES]
                for at, ids in zip(part, self._merge_together([raw[at] for at in part], depth)):
                    out[at] = ids
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _pair(self, left, right):
        return left * (self._beyond + 1) + right

    def _leaves(self, left: np.ndarray, right: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What the leaves of pairs at these places hold."""
        pairs = self._pair(left, right)
        found = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[found] == pairs, self._ranks[found] << _PLACE_BITS | places, _NONE)

    def _merge_together(self, words: list[bytes], depth: int) -> Iterator[bytes]:
        """Like :meth:`merge` for each of some words of at most ``2 ** depth - 2`` bytes, as packed ids.

        A row holds one word from its place 1 on, with nothing before and behind it, and
        its segment tree. Each round does one merge in every row that still has one.
        """
        n, width = len(words), 1 << depth
        sizes = np.fromiter(map(len, words), np.int64, n)
        every = np.arange(width)
        alive = (every > 0) & (every <= sizes[:, None])
        symbols = np.full((n, width), self._beyond, np.int64)
        symbols[alive] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rows, places = np.nonzero(alive[:, 1:] & alive[:, :-1])
        tree[rows, width + places] = self._leaves(symbols[rows, places], symbols[rows, places + 1], places)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after, before = np.tile(every + 1, (n, 1)).ravel(), np.tile(every - 1, (n, 1)).ravel()
        symbols, tree, living = symbols.ravel(), tree.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * width] != _NONE)
        while len(rows):
            at, trees = rows * width, rows * (2 * width)
            root = tree[trees + 1]
            place = root & _PLACE
            joined = self._merged_ids[root >> _PLACE_BITS]
            gone = after[at + place]
            follower = after[at + gone]
            previous = before[at + place]
            symbols[at + place] = joined
            living[at + gone] = False
            after[at + place] = follower
            before[at + follower] = place
            nodes = np.stack([gone, place, previous]) + width
            tree[trees + nodes[0]] = _NONE
            tree[trees + nodes[1]] = self._leaves(joined, symbols[at + follower], place)
            tree[trees + nodes[2]] = self._leaves(symbols[at + previous], joined, previous)
            for _ in range(depth):
                nodes >>= 1
                left = trees + 2 * nodes
                tree[trees + nodes] = np.minimum(tree[left], tree[left + 1])
            rows = rows[tree[trees + 1] != _NONE]
        packed = symbols[living].astype("<u4").tobytes()
        first = 0
        for last in (4 * np.cumsum(living.reshape(n, width).sum(axis=1))).tolist():
            yield packed[first:last]
            first = last

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of lowest rank until no adjacent pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged = self.rank.get, self.merged
        leaves = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * leaves)
        for place in range(n - 1):
            found = rank(symbols[place] << _PLACE_BITS | symbols[place + 1])
            if found is not None:
                tree[leaves + place] = found << _PLACE_BITS | place
        for node in range(leaves - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != _NONE:
            place = root & _PLACE
            joined = symbols[place] = merged[root >> _PLACE_BITS]
            gone = after[place]
            follower = after[place] = after[gone]
            tree[leaves + gone] = tree[leaves + place] = _NONE
            changed = [leaves + gone, leaves + place]
            if follower < n:
                before[follower] = place
                found = rank(joined << _PLACE_BITS | symbols[follower])
                if found is not None:
                    tree[leaves + place] = found << _PLACE_BITS | place
            previous = before[place]
            if previous >= 0:
                found = rank(symbols[previous] << _PLACE_BITS | joined)
                tree[leaves + previous] = (
                    _NONE if found is None else found << _PLACE_BITS | previous
                )
                changed.append(leaves + previous)
            for node in changed:
                node >>= 1
                while node:
                    left, right = tree[2 * node], tree[2 * node + 1]
                    if right < left:
                        left = right
                    if tree[node] == left:
                        break
                    tree[node] = left
                    node >>= 1
        place, out = 0, []
        while place < n:
            out.append(symbols[place])
            place = after[place]
        return out


def _require_plain(spec: dict) -> None:
    """Refuse files with settings this encoder does not follow, instead of encoding them wrongly."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [
        model.get("type") != "BPE" or bool(model.get("ignore_merges")),
        bool(model.get("dropout") or model.get("byte_fallback") or model.get("unk_token")),
        bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True),
        spec.get("normalizer") is not None,
        (spec.get("decoder") or {}).get("type") != "ByteLevel",
        any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]),
    ]
    if any(odd):
        raise ValueError("only plain byte-level BPE files are supported")


def _packed(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder != "little":
        values.byteswap()
    return values.tobytes()


def _unpacked(ids: bytes) -> array:
    values = array("I")
    values.frombytes(ids)
    if sys.byteorder != "little":
        values.byteswap()
    return values


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The content of a vocabulary file for all tasks; refused beyond 64 MB."""
    with open(path, "rb") as file:
        content = file.read(_LARGEST_VOCABULARY + 1)
    if len(content) > _LARGEST_VOCABULARY:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(content)


def bpe_encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids`` for each row; ids packed as little-endian unsigned 32-bit integers.

    ``path`` is a JSON vocabulary file on the driver. Special tokens of the file
    inside a text become their ids and none are added. A null text counts as
    empty and an empty text has no ids. Rows are independent: repeated keys and
    null keys give a row each. Other columns of the input are not read.
    """
    return _coded(df, path, key, text, decoded=False)


def bpe_round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`bpe_encode`, with the text decoded from the ids as ``decoded``."""
    return _coded(df, path, key, text, decoded=True)


def bpe_decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded`` for each row of packed ids; null ids count as none."""
    content = vocabulary(df.sparkSession, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(content.value)
        for batch in (part for whole in batches for part in in_parts(whole, texts=1)):
            texts = bpe.decode_all([i or b"" for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    schema = T.StructType([df.schema[key], T.StructField("decoded", T.StringType())])
    return df.select(key, ids).mapInArrow(decode, schema)


def _coded(df: DataFrame, path: str, key: str, text: str, decoded: bool) -> DataFrame:
    content = vocabulary(df.sparkSession, path)
    names = [key, "n_tokens", "ids"] + ["decoded"] * decoded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(content.value)
        for batch in (part for whole in batches for part in in_parts(whole, texts=1)):
            packed = list(bpe.encode_all(t or "" for t in batch.column(1).to_pylist()))
            columns = [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
            ]
            if decoded:
                columns.append(pa.array(bpe.decode_all(packed), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [
        df.schema[key],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
    return df.select(key, text).mapInArrow(encode, T.StructType(fields[: len(names)]))
