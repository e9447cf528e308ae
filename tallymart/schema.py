"""Row schemas of the raw feed, its layers and the published marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BUSINESS_KEY = "transaction_id"

# Column names, order and types of the sales feed.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("ship_date", T.DateType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.FloatType()),
        T.StructField("discount_pct", T.FloatType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("ingestion_date", T.DateType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()

# Columns and types of the published marts.
DAILY_SCHEMA = T.StructType(
    [
        T.StructField("order_date", T.DateType()),
        T.StructField("daily_total_revenue", T.DoubleType()),
        T.StructField("daily_total_orders", T.LongType()),
        T.StructField("daily_avg_order_value", T.DoubleType()),
    ]
)
CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("product_category", T.StringType()),
        T.StructField("category_revenue", T.DoubleType()),
        T.StructField("total_units_sold", T.LongType()),
        T.StructField("order_count", T.LongType()),
    ]
)
CITY_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("city_revenue", T.DoubleType()),
        T.StructField("order_count", T.LongType()),
        T.StructField("avg_order_value", T.DoubleType()),
    ]
)


class SchemaMismatch(ValueError):
    """A dataset does not have the columns and types its layer promises."""


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` unchanged if its names, order and types match ``expected``.

    Nullability is ignored: every field of every layer may be null.
    """
    want = [(f.name, f.dataType.simpleString()) for f in expected]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if want != have:
        missing = [w for w in want if w not in have]
        extra = [h for h in have if h not in want]
        raise SchemaMismatch(
            f"schema differs: missing {missing}, unexpected {extra}, found order {have}"
        )
    return df
