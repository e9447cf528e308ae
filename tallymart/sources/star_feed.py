"""Dirty sales feed over a star schema of order tables.

Builds the 16 feed columns from ``lineitem, orders, customer, nation, region,
part`` with integer arithmetic on their keys only, so any SQL engine builds
the same rows and results can be compared by value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.draws import between, pick
from tallymart.schema import RAW_COLUMNS

# Unique together with the transaction id; kept beside the feed until dedup.
LINE_ORDER = (
    "order_date",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
)
INGESTION_DATE = dt.date(2026, 1, 1)

# The columns read from each table. Declared, so that planning a
# query opens no file.
STAR_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def line_salt() -> Column:
    """A number spread over the lines, from which all defects are derived."""
    return (
        F.col("l_orderkey") * 31
        + F.col("l_linenumber") * 17
        + F.col("l_partkey") * 13
        + F.col("l_suppkey") * 7
    )


def star_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed plus the line columns of ``LINE_ORDER``.

    The small tables are joined to each other first, so the lines are joined
    twice rather than once per table. Which side is broadcast is left to
    Spark, which checks its size.
    """
    places = (
        star_table(spark, folder, "customer")
        .join(star_table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(star_table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    placed = star_table(spark, folder, "orders").join(
        places, F.expr("o_custkey = c_custkey")
    )
    lines = (
        star_table(spark, folder, "lineitem")
        .join(star_table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
        .join(placed, F.expr("l_orderkey = o_orderkey"))
        .withColumn("k", line_salt())
    )
    k = F.col("k")
    statuses = F.create_map(
        *[F.lit(v) for v in ("A", "Delivered", "N", "Cancelled", "R", "Returned")]
    )
    feed = {
        "transaction_id": F.concat(
            F.lit("T"),
            F.col("l_orderkey").cast("string"),
            F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ),
        "order_date": F.col("o_orderdate").cast("date"),
        "ship_date": F.col("l_shipdate").cast("date"),
        "customer_id": F.concat(F.lit("CUST"), F.col("c_custkey").cast("string")),
        "customer_age": F.when(k % 4 == 0, between(k, 18, 70))
        .when(k % 4 == 1, between(k, -10, 10))
        .when(k % 4 == 2, between(k, 120, 200))
        .cast("int"),
        "gender": pick(k, ["M", "F", " male", "Female", None]),
        "product_id": F.concat(F.lit("PROD"), F.col("p_partkey").cast("string")),
        "product_category": F.col("p_type"),
        "quantity": F.when(k % 3 == 0, F.col("l_quantity").cast("int"))
        .when(k % 3 == 1, F.lit(0))
        .otherwise((F.lit(-1) - k % 5).cast("int")),
        "unit_price": F.when(k % 7 == 0, -F.col("p_retailprice"))
        .when(k % 7 == 3, F.col("p_retailprice") + F.lit(0.005))
        .when(k % 7 > 1, F.col("p_retailprice"))
        .cast("float"),
        "discount_pct": F.when(k % 11 == 0, between(k, 60, 150).cast("double"))
        .when(k % 11 == 2, F.lit(-1.0))
        .when(k % 11 == 3, F.col("l_discount") * 100 + F.lit(0.345))
        .when(k % 11 > 2, F.col("l_discount") * 100)
        .cast("float"),
        "city": F.col("n_name"),
        "state": F.col("r_name"),
        "payment_type": pick(
            F.col("l_partkey") + F.col("l_linenumber"),
            ["Card", "UPI", "COD", "Crypto", "card", None],
        ),
        "order_status": statuses[F.col("l_returnflag")],
        "ingestion_date": F.lit(INGESTION_DATE),
    }
    tie_break = [c for c in LINE_ORDER if c not in feed]
    return lines.select(
        *[feed[name].alias(name) for name in RAW_COLUMNS], *tie_break
    )
