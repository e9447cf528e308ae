"""Window results over a whole table without moving it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.sources.scratch import written

# monotonically_increasing_id holds the partition above 33 bits of row number
_ROW_BITS = 33


def running_total(
    rows: DataFrame, order: Sequence[Column], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Add the sum of ``value`` over all rows that come before a row in ``order``; 0 for the first.

    Spark draws range splitters from the order columns and deals the rows out by them, so
    many close values spread over all tasks like any others. The sorted ranges are written
    (splitters are drawn anew whenever a plan runs), summed up one by one, and only these
    sums, one for each range, are added up in order in one task. Rows that are equal in
    all of ``order`` share a range; count such rows first where they may be many.
    Nulls in ``value`` count as 0; an empty table stays empty.
    """
    if partitions is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_band", F.shiftright("_place", _ROW_BITS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    lower = (
        placed.groupBy("_band")
        .agg(F.sum(value).alias("_sum"))
        .select(
            F.col("_band").alias("_band_ahead"),
            F.coalesce(F.sum("_sum").over(before.orderBy("_band")), F.lit(0)).alias("_ahead"),
        )
    )
    within = F.sum(value).over(before.partitionBy("_band").orderBy("_place"))
    return (
        placed.withColumn("_within", F.coalesce(within, F.lit(0)))
        .join(lower, F.col("_band") == F.col("_band_ahead"))
        .select(*rows.columns, (F.col("_ahead") + F.col("_within")).cast("bigint").alias(name))
    )


def with_rank_desc(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the 1-based rank of ``value``, largest first, ties sharing a rank, nulls last.

    A plain ``rank().over(orderBy)`` moves the whole table into one task. Here equal
    values, nulls among them, are counted first, which combines per task, and a value's
    rank is the running total of these counts. The table is written first, since it is
    read twice.
    """
    df = written(df, "ranked")
    distinct = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = running_total(distinct, [F.desc_nulls_last("_value")], "_rows", "_larger")
    ranks = ahead.select("_value", (F.col("_larger") + F.lit(1)).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).select(*df.columns, name)


def with_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows; ``key`` is any column that varies.

    The two sides of the join share their input's last shuffle, so it is computed once; a
    scalar subquery would be planned, and under adaptive execution run, separately.
    Sums go through slices, more than the session has shuffle partitions and at
    most twice as many, and only those are added up in one task.
    """
    # Never null by its form: a null check on one side would keep Spark from
    # seeing that both sides have the same input.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << partitions.bit_length()) - 1
    sliced = df.withColumn("_slice", F.xxhash64(key).bitwiseAND(F.lit(mask)))
    totals = (
        sliced.groupBy("_slice")
        .agg(F.sum(value).alias("_sum"))
        .select(
            F.col("_slice").alias("_slice_summed"),
            F.sum("_sum").over(Window.partitionBy()).alias(name),
        )
    )
    joined = sliced.join(totals, F.col("_slice") == F.col("_slice_summed"))
    return joined.select(*df.columns, name)
