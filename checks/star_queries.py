"""Every library operation as a query ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import money
from tallymart.operators import marts, rollups
from tallymart.operators.dedup import dedup, duplicate_keys
from tallymart.operators.rules import SALES_RULES, apply_rules, dq_report, rule
from tallymart.plans.pipeline import Layout, run_pipeline
from tallymart.plans.silver import clean, layer_counts
from tallymart.schema import (
    BUSINESS_KEY,
    CATEGORY_SCHEMA,
    CITY_SCHEMA,
    DAILY_SCHEMA,
    RAW_COLUMNS,
)
from tallymart.sources.csv_feed import read_raw_csv, write_raw_csv
from tallymart.sources.layers import read_layer
from tallymart.sources.scratch import scratch_path
from tallymart.sources.star_feed import (
    INGESTION_DATE,
    LINE_ORDER,
    star_feed,
    star_table,
)
from tallymart.sources.synthetic import dirty_sales

Query = Callable[[SparkSession, str], DataFrame]


def _bronze(spark: SparkSession, folder: str) -> DataFrame:
    return star_feed(spark, folder).select(*RAW_COLUMNS)


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    return clean(star_feed(spark, folder), LINE_ORDER)


def _amounts(spark: SparkSession, folder: str, mode: str = money.EXACT) -> DataFrame:
    return marts.with_total_amount(_silver(spark, folder), mode)


# ---- sources, sinks, staged jobs


def bronze_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The feed written as CSV and scanned back under the enforced schema."""
    path = scratch_path(spark, "bronze-ingest")
    write_raw_csv(_bronze(spark, folder), path)
    return read_raw_csv(spark, path)


def layer_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as delivered, after deduplication and after all rules."""
    return layer_counts(star_feed(spark, folder), LINE_ORDER)


def pipeline_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Raw CSV through all stages on disk; the three marts read back, in one table."""
    root = scratch_path(spark, "pipeline")
    layout = Layout.under(root, raw=f"{root}/raw")
    write_raw_csv(_bronze(spark, folder), layout.raw)
    run_pipeline(spark, layout, bronze_files=24, silver_files=8, order_by=RAW_COLUMNS)
    daily = read_layer(spark, layout.daily, DAILY_SCHEMA).select(
        F.lit("daily").alias("mart"),
        F.col("order_date").cast("string").alias("group_key"),
        F.col("daily_total_revenue").alias("revenue"),
        F.col("daily_total_orders").alias("orders"),
        F.col("daily_avg_order_value").alias("avg_order_value"),
        F.lit(None).cast("bigint").alias("units"),
    )
    category = read_layer(spark, layout.category, CATEGORY_SCHEMA).select(
        F.lit("category").alias("mart"),
        F.col("product_category").alias("group_key"),
        F.col("category_revenue").alias("revenue"),
        F.col("order_count").alias("orders"),
        F.lit(None).cast("double").alias("avg_order_value"),
        F.col("total_units_sold").alias("units"),
    )
    city = read_layer(spark, layout.city, CITY_SCHEMA).select(
        F.lit("city").alias("mart"),
        F.concat_ws("|", "city", "state").alias("group_key"),
        F.col("city_revenue").alias("revenue"),
        F.col("order_count").alias("orders"),
        F.col("avg_order_value"),
        F.lit(None).cast("bigint").alias("units"),
    )
    return daily.unionByName(category).unionByName(city)


def synth_source(spark: SparkSession, folder: str) -> DataFrame:
    """One generated dirty row per order line, ids drawn from half the line count."""
    lines = star_table(spark, folder, "lineitem")
    ids = lines.agg(F.greatest(F.floor(F.count(F.lit(1)) / 2), F.lit(1))).scalar()
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber")  # line numbers go up to 7
    return dirty_sales(lines.select(row.alias("row_key")), "row_key", ids, INGESTION_DATE)


# ---- deduplication and rules


def duplicate_key_report(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_keys(_bronze(spark, folder), BUSINESS_KEY)


def dedup_transactions(spark: SparkSession, folder: str) -> DataFrame:
    feed = star_feed(spark, folder)
    return dedup(feed, BUSINESS_KEY, LINE_ORDER).select(*RAW_COLUMNS)


def single_rule(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One rule alone over all bronze rows."""
    wanted = dict.fromkeys([BUSINESS_KEY, "order_date", rule(name).column])
    return apply_rules(_bronze(spark, folder), [rule(name)]).select(*wanted)


def data_quality(spark: SparkSession, folder: str) -> DataFrame:
    return dq_report(_bronze(spark, folder), BUSINESS_KEY)


# ---- measure and marts


def total_amount(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """The measure per silver row."""
    amount = F.col("total_amount").cast("double").alias("total_amount")
    return _amounts(spark, folder, mode).select(
        BUSINESS_KEY, "quantity", "unit_price", "discount_pct", amount
    )


def daily_sales(spark: SparkSession, folder: str, mode: str = money.EXACT) -> DataFrame:
    return marts.daily_mart(marts.facts(_amounts(spark, folder, mode), "order_date"))


def category_performance(
    spark: SparkSession, folder: str, mode: str = money.EXACT
) -> DataFrame:
    rows = _amounts(spark, folder, mode)
    return marts.category_mart(marts.facts(rows, "product_category"))


def city_revenue(spark: SparkSession, folder: str, mode: str = money.EXACT) -> DataFrame:
    return marts.city_mart(marts.facts(_amounts(spark, folder, mode), "city", "state"))


def cube(spark: SparkSession, folder: str) -> DataFrame:
    facts = marts.sales_cube(_amounts(spark, folder))
    return facts.withColumn("amount", marts.revenue())


def report(
    spark: SparkSession,
    folder: str,
    rollup: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...],
) -> DataFrame:
    """A report over facts at the grain it needs, or any finer one such as the whole cube."""
    return rollup(marts.facts(_amounts(spark, folder), *keys))


def registered() -> dict[str, Query]:
    day, category, place = ("order_date",), ("product_category",), ("city", "state")
    reports = {
        rollups.kpi_category_totals: category,
        rollups.category_order_share: category,
        rollups.category_revenue_rank: category,
        rollups.category_units_revenue: category,
        rollups.category_revenue_ratio: category,
        rollups.monthly_orders: day,
        rollups.monthly_revenue: day,
        rollups.calendar_month_trend: day,
        rollups.kpi_daily: day,
        rollups.state_metrics: place,
        rollups.kpi_states: place,
        rollups.city_revenue_bubble: place,
    }
    by_mode = {
        "daily_sales_metrics": daily_sales,
        "product_category_performance": category_performance,
        "city_revenue_metrics": city_revenue,
    }
    return {
        "bronze_ingest": bronze_ingest,
        "layer_row_counts": layer_row_counts,
        "pipeline_end_to_end": pipeline_end_to_end,
        "synth_source": synth_source,
        "duplicate_keys": duplicate_key_report,
        "dedup_transactions": dedup_transactions,
        **{f"rule_{r.name}": partial(single_rule, name=r.name) for r in SALES_RULES},
        "silver_clean": _silver,
        "dq_report": data_quality,
        "total_amount": partial(total_amount, mode=money.EXACT),
        "total_amount_float": partial(total_amount, mode=money.FLOAT),
        **by_mode,
        **{f"{n}_float": partial(q, mode=money.FLOAT) for n, q in by_mode.items()},
        "sales_cube": cube,
        **{f.__name__: partial(report, rollup=f, keys=k) for f, k in reports.items()},
        **{
            f"cube_{f.__name__}": partial(report, rollup=f, keys=marts.CUBE_KEYS)
            for f in rollups.REPORTS
        },
    }
