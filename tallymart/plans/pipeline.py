"""The staged batch jobs: raw CSV to bronze, silver and gold Parquet.

Every stage reads and writes by path and leaves the session to its caller, so
the three can run in one application or three.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import money
from tallymart.operators import marts
from tallymart.operators.rollups import REPORTS
from tallymart.operators.rules import dq_report
from tallymart.plans.silver import finish, surviving_copies
from tallymart.plans.sizing import into_files, scan_sized, shuffle_sized
from tallymart.schema import BUSINESS_KEY, RAW_SCHEMA
from tallymart.sources.csv_feed import read_raw_csv
from tallymart.sources.layers import assert_apart, read_layer, write_layer


@dataclass(frozen=True)
class Layout:
    """Where the layers live; ``Layout.under`` gives the usual places."""

    raw: str
    bronze: str
    silver: str
    daily: str
    category: str
    city: str
    cube: str

    @classmethod
    def under(cls, root: str, raw: str | None = None) -> Layout:
        root = root.rstrip("/")
        # Folder and file names of the layers.
        return cls(
            raw=raw or f"{root}/raw/retail_sales_raw.csv",
            bronze=f"{root}/bronze",
            silver=f"{root}/silver",
            daily=f"{root}/gold/daily_sales_metrics",
            category=f"{root}/gold/product_category_performance",
            city=f"{root}/gold/city_revenue_metrics",
            cube=f"{root}/gold/sales_cube",
        )


#: What the marts are grouped by, and the whole.
MART_GRAINS = (("order_date",), ("product_category",), ("city", "state"), ())


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without a job of its own.

    Callers place this in the stage that writes, after the last shuffle: only
    there does a repeated task not count its rows again.
    """
    rows = Observation(name)
    return df.observe(rows, F.count(F.lit(1)).alias("rows")), rows


def run_bronze(
    spark: SparkSession,
    input: str,
    output: str,
    files: int | None = None,
    check_header: bool = True,
) -> dict[str, int]:
    """Raw CSV to typed Parquet, all rows kept. Returns the row count.

    Without ``files`` there is no shuffle: every CSV split is written where it
    was read. With ``files`` splits are put together, and shuffled only if they are fewer
    or the cluster has more cores than files.
    """
    assert_apart([input], [output])
    raw = read_raw_csv(scan_sized(spark, input, files), input, check_header)
    if files is not None:
        raw = into_files(raw, files)
    raw, rows = _counted(raw, "bronze")
    write_layer(raw, output)
    return {"bronze": rows.get["rows"]}


def run_silver(
    spark: SparkSession,
    input: str,
    output: str,
    files: int | None = None,
    order_by: Sequence[str] | None = None,
) -> dict[str, int]:
    """Bronze to cleaned Parquet in one job with one shuffle. Returns row counts.

    With ``files`` that shuffle has a multiple of partitions that fit in memory; each file is
    written from several, one after the other. The bronze count is a scan without columns: counting on the way to the shuffle would
    count the rows of a repeated task twice.
    """
    assert_apart([input], [output])
    delivered = read_layer(spark, input, RAW_SCHEMA).count()
    bronze = read_layer(shuffle_sized(spark, input, files), input, RAW_SCHEMA)
    survivors = surviving_copies(bronze, order_by)
    survivors, kept = _counted(survivors, "deduplicated")
    silver, cleaned = _counted(finish(survivors), "silver")
    if files is not None:
        silver = silver.coalesce(files)
    write_layer(silver, output)
    return {
        "bronze": delivered,
        "deduplicated": kept.get["rows"],
        "silver": cleaned.get["rows"],
    }


def run_gold(
    spark: SparkSession,
    input: str,
    daily_output: str,
    category_output: str,
    city_output: str,
    cube_output: str,
    mode: str = money.EXACT,
) -> dict[str, int]:
    """Silver to the sales cube and, from it, the three marts.

    Silver is scanned once; all marts come from one pass over the much smaller stored cube,
    whose few rows are kept while they are written out. A scan task
    sends at most one row for each cell of the cube, so the reducers are the session's,
    merged by adaptive execution, and do not grow with silver. Returns how many rows
    could not be priced.
    """
    assert_apart([input], [daily_output, category_output, city_output, cube_output])
    silver = read_layer(scan_sized(spark, input), input, RAW_SCHEMA)
    rows = marts.with_total_amount(silver, mode)
    write_layer(marts.sales_cube(rows), cube_output)
    cube = read_layer(scan_sized(spark, cube_output), cube_output)
    several = marts.roll_ups(cube, MART_GRAINS).persist()
    try:
        by_day, by_category, by_city, whole = (
            marts.at_grain(several, MART_GRAINS, at) for at in range(len(MART_GRAINS))
        )
        write_layer(marts.daily_mart(by_day), daily_output)
        write_layer(marts.category_mart(by_category), category_output)
        write_layer(marts.city_mart(by_city), city_output)
        lost = whole.first()
    finally:
        several.unpersist()
    return {"unpriceable": lost["unpriceable"] if lost else 0}


def run_reports(spark: SparkSession, input: str, output: str) -> list[str]:
    """The stored cube to one folder for each report query below ``output``; returns their names."""
    assert_apart([input], [output])
    cube = read_layer(scan_sized(spark, input), input)
    for report in REPORTS:
        write_layer(report(cube), f"{output.rstrip('/')}/{report.__name__}")
    return [report.__name__ for report in REPORTS]


def run_dq_report(spark: SparkSession, input: str, output: str) -> None:
    """Stored bronze to the data quality report."""
    assert_apart([input], [output])
    bronze = read_layer(shuffle_sized(spark, input), input, RAW_SCHEMA)
    write_layer(dq_report(bronze, BUSINESS_KEY), output)


def run_pipeline(
    spark: SparkSession,
    layout: Layout,
    bronze_files: int | None = None,
    silver_files: int | None = None,
    mode: str = money.EXACT,
    order_by: Sequence[str] | None = None,
    check_header: bool = True,
) -> dict[str, int]:
    """All three stages in order; an error in one keeps the next from starting."""
    counts = run_bronze(spark, layout.raw, layout.bronze, bronze_files, check_header)
    counts |= run_silver(spark, layout.bronze, layout.silver, silver_files, order_by)
    counts |= run_gold(
        spark,
        layout.silver,
        layout.daily,
        layout.category,
        layout.city,
        layout.cube,
        mode,
    )
    return counts
