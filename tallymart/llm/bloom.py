"""A Bloom filter of bounded size that tasks build and read in a shared folder.

It has 16 bits for each hash up to ``MOST_BITS``, cut into segments of a megabyte.
Beyond 67 million hashes it lets more rows pass that a join then removes; it never
holds back a row that is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.shared_files import Folder

BITS_EACH = 16
MOST_BITS = 1 << 30
SEGMENT_BITS = 1 << 23


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each 64-bit hash, from its halves."""
    unsigned = hashes.view(np.uint64)
    return np.stack([unsigned & np.uint64(bits - 1), (unsigned >> np.uint64(32)) & np.uint64(bits - 1)])


def written(hashes: DataFrame, folder: str, segment_bits: int = SEGMENT_BITS) -> int:
    """Write the filter of a column ``hash``; returns its bits, which :func:`may_hold` needs."""
    n = hashes.count()
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * n - 1).bit_length() if n else 0))
    Folder(folder).made()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(batch.column(0).to_numpy(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots // segment_bits), pa.array(slots)], ["segment", "slot"])

    def build(table: pa.Table) -> pa.Table:
        segment, marks = table.column("segment")[0].as_py(), np.zeros(min(bits, segment_bits), bool)
        marks[table.column("slot").to_numpy() % segment_bits] = True
        with Folder(folder).new(f"segment-{segment}") as stream:
            stream.write(np.packbits(marks, bitorder="little").tobytes())
        return pa.table({"set": pa.array([int(marks.sum())], pa.int64())})

    slots = hashes.select("hash").mapInArrow(placed, "segment long, slot long").distinct()
    slots.groupBy("segment").applyInArrow(build, "set long").agg(F.sum("set")).collect()
    return bits


def may_hold(hashed: Column, folder: str, bits: int, segment_bits: int = SEGMENT_BITS) -> Column:
    """False only for hashes that are not in the filter."""

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        segments = _segments(folder, bits, segment_bits)
        found = np.ones(len(hashes), bool)
        for slots in _slots(hashes.to_numpy(np.int64), bits):
            numbers, within = (slots // np.uint64(segment_bits)).astype(np.int64), slots % np.uint64(segment_bits)
            for number in np.unique(numbers):
                mine = np.flatnonzero(numbers == number)
                if segments[number] is None:
                    found[mine] = False
                    continue
                at = within[mine].astype(np.int64)
                found[mine] &= (segments[number][at >> 3] >> (at & 7) & 1).astype(bool)
        return pd.Series(found)

    return held(hashed)


@lru_cache(maxsize=2)
def _segments(folder: str, bits: int, segment_bits: int) -> list[np.ndarray | None]:
    files = Folder(folder)
    there = {info.base_name for info in files.system.get_file_info(fs.FileSelector(files.path))}
    names = [f"segment-{k}" for k in range(max(1, bits // segment_bits))]
    return [files.array(name, "u1") if name in there else None for name in names]
