"""One row per business key, and a report of the keys that had more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT = "_fingerprint"


def fingerprint(columns: Sequence[str]) -> Column:
    """64 bits that depend on every value of a row and on which values are null.

    The hash alone skips nulls, so rows whose values sit in different columns
    could share it; hence the flags. Two differing copies of one key share a
    fingerprint with a chance of one in 2**64.
    """
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def with_order(
    df: DataFrame, key: str, order_by: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """The columns that decide between copies of a key, added to ``df`` where needed.

    Without ``order_by`` the copy with the smallest fingerprint of its content
    is kept. That choice favours no value of any column, as an order by the
    columns themselves would (by date, say, it would keep the earliest order
    and shift every monthly figure), yet it is the same on every run.
    """
    if order_by:
        return df, [c for c in order_by if c != key]
    others = [c for c in df.columns if c != key]
    return df.withColumn(FINGERPRINT, fingerprint(others)), [FINGERPRINT]


def dedup(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of every ``key`` under ``order_by``, ascending, nulls first.

    See ``with_order`` for the default. ``order_by`` should leave no ties
    between differing rows; then the result does not depend on how the input
    is partitioned, nor on tasks that run again.

    Rows with a null key count as copies of each other and one survives.

    Spark keeps one row per key and map task before the shuffle, so a key
    holding a large part of all rows costs no more than any other.
    """
    ordered, ordering = with_order(df, key, order_by)
    copies = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in ordering])
    return (
        ordered.withColumn("_copy", F.row_number().over(copies))
        .where("_copy = 1")
        .select(*df.columns)
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, and how many; null counts as a key."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )
