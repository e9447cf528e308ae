"""Lines that many documents share, found through sharded minimal perfect hashes.

1. Every distinct text sends the 128-bit hashes of its distinct lines; copies of a text
   are counted first. Hashes are counted by documents, combined per task.
2. The distinct hashes are dealt into shards by range. A shard is a file: a minimal
   perfect hash (see :mod:`tallymart.llm.perfect_hash`), which gives each line a number,
   and by that number an array of 32-bit fingerprints and one of counts, in the narrowest
   type that tells counts below the limit from others.
3. Each text's hashes go, in ranges of equal size, to tasks that map a few shards into
   memory and read the counts from the arrays. A line that is frequent makes a long
   range of its shard, which several tasks then probe. No line is joined with another.
4. The frequent hashes of a text, if it has any, go back to its documents.

A task holds a shard or two of about ``SHARD_KEYS`` lines and a batch, however many lines
there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.chunks import in_parts
from tallymart.llm.perfect_hash import PerfectHash
from tallymart.llm.shared_files import Folder
from tallymart.llm.tables import stored
from tallymart.sources.scratch import scratch_path

SHARD_KEYS = 1 << 20
SPACE = b" \t\n\v\f\r"
_HASH = np.dtype([("high", ">u8"), ("low", ">u8")])
_ROWS = 1 << 16


def line_key(line: bytes) -> bytes:
    """White space at both ends stripped, A-Z lower-cased; ``bytes.lower`` changes no others."""
    return line.strip(SPACE).lower()


def line_hashes(text: str | None, least_chars: int) -> bytes:
    """The sorted distinct hashes of a text's line keys of ``least_chars`` code points or more."""
    keys = {line_key(line) for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")}
    return b"".join(sorted(xxhash.xxh3_128_digest(key) for key in keys if _long(key, least_chars)))


def _long(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (
        len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars
    )


def _print(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _texts(df: DataFrame, text: str, least_chars: int) -> DataFrame:
    """``print, hashes, n`` of each distinct text with a line that counts; ``n`` documents have it."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1):
                hashes = [line_hashes(t, least_chars) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], ["print", "hashes"])

    found = df.select(_print(text).alias("print"), F.col(text).alias("text"))
    found = found.mapInArrow(extract, "print binary, hashes binary").where("octet_length(hashes) > 0")
    return found.groupBy("print").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n"))


def _lines(texts: DataFrame, carried: str, kind: str) -> DataFrame:
    """``high, low`` of each of the ``hashes``, beside a column of their text."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 0):
                packed = part.column(0).to_pylist()
                found = np.frombuffer(b"".join(packed), _HASH)
                rows = np.repeat(np.arange(len(packed)), [len(p) // _HASH.itemsize for p in packed])
                for at in range(0, len(found), _ROWS):
                    some = found[at : at + _ROWS]
                    halves = [pa.array(some[h].astype(np.uint64).view(np.int64)) for h in ("high", "low")]
                    own = part.column(1).take(pa.array(rows[at : at + _ROWS]))
                    yield pa.RecordBatch.from_arrays([*halves, own], ["high", "low", carried])

    return texts.select("hashes", carried).mapInArrow(opened, f"high long, low long, {carried} {kind}")


def _sharded(lines: DataFrame, shards: int) -> DataFrame:
    """With ``shard``, a range of the hashes."""
    high = F.shiftrightunsigned("high", 32)
    return lines.withColumn("shard", F.shiftright(high * F.lit(shards), 32).cast("int"))


class Shard:
    """The lines of one range of hashes: fingerprints and counts by perfect-hash number."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.index, self.prints, self.counts = index, prints, counts

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, kind: np.dtype) -> Shard:
        index = PerfectHash.of(high, low)
        numbers = index.numbers(high, low)
        prints, own = np.empty(len(high), np.uint32), np.empty(len(high), kind)
        prints[numbers] = low.astype(np.uint32)
        own[numbers] = np.minimum(counts, np.iinfo(kind).max)
        return cls(index, prints, own)

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The documents with each line, up to the type's largest number; 0 for a line not in the shard."""
        if not len(self.prints):
            return np.zeros(len(high), np.int64)
        numbers = self.index.numbers(high, low)
        there = (numbers >= 0) & (self.prints[numbers] == low.astype(np.uint32))
        return np.where(there, self.counts[numbers], 0).astype(np.int64)

    def written(self, folder: Folder, name: str) -> None:
        """One file: the arrays' lengths, then the arrays, each filled up to eight bytes."""
        arrays = [self.index.sizes, self.index.words, self.prints, self.counts]
        with folder.new(name) as stream:
            stream.write(np.array([*map(len, arrays), self.counts.itemsize], "<i8").tobytes())
            for array in arrays:
                packed = array.astype(array.dtype.newbyteorder("<")).tobytes()
                stream.write(packed + bytes(-len(packed) % 8))

    @classmethod
    def read(cls, folder: Folder, name: str) -> Shard:
        content = folder.array(name, "u1")
        *lengths, width = content[:40].view("<i8").tolist()
        at, found = 40, []
        for length, kind in zip(lengths, ("<i8", "<u8", "<u4", f"<u{width}")):
            size = length * np.dtype(kind).itemsize
            found.append(content[at : at + size].view(kind))
            at += size + -size % 8
        return cls(PerfectHash(*found[:2]), *found[2:])


def write_line_index(counted: DataFrame, folder: str, shards: int, least: int) -> int:
    """Write a shard for each range of the distinct hashes ``high, low`` with documents ``n``; returns the lines.

    A range without lines has no file. Counts of ``least`` or more are told from smaller ones.
    """
    kind = np.min_scalar_type(max(least, 1))
    Folder(folder).made()

    def build(table: pa.Table) -> pa.Table:
        high, low, n = (table.column(c).to_numpy() for c in ("high", "low", "n"))
        shard = Shard.of(high.view(np.uint64), low.view(np.uint64), n, kind)
        shard.written(Folder(folder), _name(table.column("shard")[0].as_py()))
        return pa.table({"lines": pa.array([len(high)], pa.int64())})

    built = _sharded(counted, shards).groupBy("shard").applyInArrow(build, "lines long")
    return built.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]


def _name(shard: int) -> str:
    return f"lines-{shard:08d}"


def probed(lines: DataFrame, folder: str, shards: int, least: int) -> DataFrame:
    """``print, hash`` of the lines ``print, high, low`` that the index has in ``least`` documents or more."""
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, open_shard, index = Folder(folder), None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            high, low = (batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            starts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for first, last in zip(starts, starts[1:]):
                if first == last:
                    continue
                if shard[first] != open_shard:
                    open_shard, index = shard[first], Shard.read(files, _name(int(shard[first])))
                often = np.flatnonzero(index.count(high[first:last], low[first:last]) >= least) + first
                found = np.empty(len(often), _HASH)
                found["high"], found["low"] = high[often], low[often]
                packed = pa.py_buffer(found.tobytes())
                hashes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(often), [None, packed])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("print").take(pa.array(often)), hashes.cast(pa.binary())], ["print", "hash"]
                )

    dealt = _sharded(lines, shards).repartitionByRange(partitions, "shard", "print")
    return dealt.sortWithinPartitions("shard").mapInArrow(probe, "print binary, hash binary")


def without_common_lines(
    df: DataFrame, least: int, least_chars: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_lines, n_dropped, kept`` for each row: the text without lines that many documents have.

    A text is split at LF; null or empty, it is one empty line. A line's key is the line
    without space, tab, LF, VT, FF and CR at both ends, A-Z lower-cased. Keys of at least
    ``least_chars`` code points in at least ``least`` documents lose all their lines; the
    others stay as they were, joined by LF. Each row is a document, repeated ones too, and
    counts a key once however often it has it. An empty table gives no rows. Other
    columns of the input are not read.
    """
    spark = df.sparkSession
    texts = stored(_texts(df, text, least_chars), "line-hashes")
    counted = _lines(texts, "n", "long").groupBy("high", "low").agg(F.sum("n").alias("n"))
    counted = stored(counted, "line-counts")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-counted.count() // SHARD_KEYS))
    folder = scratch_path(spark, "line-index")
    write_line_index(counted, folder, shards, least)
    lines = stored(_lines(texts, "print", "binary"), "lines")
    common = probed(lines, folder, shards, least).groupBy("print").agg(F.collect_list("hash").alias("drop"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), _print(text).alias("print"))
    both = rows.join(stored(common, "common-lines"), "print", "left").select("key", "text", "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1):
                found = [_cut(t or "", d) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                n, dropped, kept = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                    [key, "n_lines", "n_dropped", "kept"],
                )

    kind = df.schema[key].dataType.simpleString()
    return both.mapInArrow(cut, f"`{key}` {kind}, n_lines long, n_dropped long, kept string")


def _cut(text: str, drop: list[bytes] | None) -> tuple[int, int, str]:
    if not drop:
        return text.count("\n") + 1, 0, text
    lines, gone = text.split("\n"), set(drop)
    kept = [x for x in lines if xxhash.xxh3_128_digest(line_key(x.encode("utf-8", "surrogatepass"))) not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)
