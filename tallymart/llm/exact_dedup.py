"""Exact deduplication by counting quotient filters.

A text's 64-bit fingerprint is cut into a quotient (high bits) and a remainder.
A filter keeps, for each quotient, the sorted run of remainders with a count.
Each partition builds its own filter; filters of the same quotient range merge
without loss, since merging sorted runs adds up counts. Only fingerprints with a
count above one go on: the texts behind them are compared as bytes. Whatever the
number of copies, a partition sends each fingerprint once, and each text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.tables import stored

FILTER_SCHEMA = "slice int, quotients binary, runs binary, remainders binary, counts binary"


class CountingQuotientFilter:
    """Sorted runs of remainders by quotient, with counts; no fingerprint is lost or confused."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From unsigned 64-bit fingerprints in any order, each counted once or as given."""
        if counts is None:
            distinct, counts = np.unique(fingerprints, return_counts=True)
        else:
            distinct, place = np.unique(fingerprints, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, counts)
            counts = total
        quotients, runs = np.unique((distinct >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), distinct.astype(np.uint32), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        high = np.repeat(self.quotients, self.runs).astype(np.uint64) << np.uint64(32)
        return high | self.remainders.astype(np.uint64)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.of(
            np.concatenate([f.fingerprints() for f in filters]),
            np.concatenate([f.counts for f in filters]),
        )

    def sliced(self, slices: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut into ranges of quotients of equal width."""
        which = (self.quotients.astype(np.uint64) * np.uint64(slices)) >> np.uint64(32)
        ends = np.concatenate(([0], np.cumsum(self.runs, dtype=np.int64)))
        for at in np.unique(which):
            first, last = np.searchsorted(which, at, "left"), np.searchsorted(which, at, "right")
            inside = slice(ends[first], ends[last])
            yield int(at), CountingQuotientFilter(
                self.quotients[first:last], self.runs[first:last], self.remainders[inside], self.counts[inside]
            )

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(a.tobytes() for a in (self.quotients, self.runs, self.remainders, self.counts))

    @classmethod
    def unpacked(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        small = [np.frombuffer(b, np.uint32) for b in (quotients, runs, remainders)]
        return cls(*small, np.frombuffer(counts, np.int64))


def repeated_fingerprints(fingerprints: DataFrame, slices: int) -> DataFrame:
    """``fp, n``: the fingerprints that occur more than once in the one column, with their counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: CountingQuotientFilter | None = None
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            more = CountingQuotientFilter.of(values)
            own = CountingQuotientFilter.merged([own, more]) if own else more
        if own:
            rows = [(at, *part.packed()) for at, part in own.sliced(slices)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))],
                names=["slice", "quotients", "runs", "remainders", "counts"],
            )

    def merge(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("quotients", "runs", "remainders", "counts")]
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.unpacked(*row) for row in zip(*columns)])
        many = whole.counts > 1
        return pa.table({"fp": whole.fingerprints()[many].view(np.int64), "n": whole.counts[many]})

    return (
        fingerprints.mapInArrow(build, FILTER_SCHEMA)
        .groupBy("slice")
        .applyInArrow(merge, "fp long, n long")
    )


def _routed(rows: DataFrame) -> DataFrame:
    """The repeated fingerprints of a column ``fp``, written, so that their number is known."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(repeated_fingerprints(rows.select("fp"), slices).select("fp"), "fingerprints")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for each row.

    ``keep_id`` is the largest key among the rows of equal text; a null text
    equals an empty one. Null keys are smaller than all others: such a row stays
    only if its whole group has no key. Rows that share key and text are the same
    document, listed and counted as often as they come, and kept alike. An empty
    table gives no rows. Other columns of the input are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    routed = _routed(rows)
    digest = F.sha2("text", 256).alias("text_sha256")
    copies = stored(rows.join(routed, "fp", "left_semi"), "copies")
    groups = copies.groupBy("fp", "text").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    # written, so that the join below has plain shuffles on both sides, which adaptive execution can split
    groups = stored(groups, "copy-groups")
    in_groups = copies.join(groups, ["fp", "text"]).select("key", "keep_id", "group_size", digest)
    single = (
        rows.select("key", "fp", digest)
        .join(routed, "fp", "left_anti")
        .select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    )
    return single.unionByName(in_groups).select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text, the one with the largest key, with the columns of the input.

    Of rows that share key and text, the largest by the other columns stays.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("fp"))
    routed = _routed(rows)
    single = rows.join(routed, "fp", "left_anti").select("row")
    best = (
        rows.join(routed, "fp", "left_semi")
        .groupBy("fp", "text")
        .agg(F.max(F.struct("key", "row")).alias("best"))
        .select(F.col("best.row").alias("row"))
    )
    return single.unionByName(best).select("row.*")
