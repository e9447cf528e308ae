"""Seeded generator of dirty sales, as a Spark job.

Rows carry the defects the rules look for: repeated ids, ship dates before
order dates, zero and negative quantities and prices, discounts and ages out
of range, mixed gender labels, an unsupported payment type, and nulls.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.draws import DRAW_SPAN, between, draw, pick, wide
from tallymart.schema import RAW_SCHEMA

# The generated feed's places, prefixes, ranges, labels and date range.
PLACES = [
    ("New York", "NY"),
    ("Los Angeles", "CA"),
    ("Chicago", "IL"),
    ("Houston", "TX"),
    ("Phoenix", "AZ"),
    ("Philadelphia", "PA"),
    ("San Antonio", "TX"),
    ("San Diego", "CA"),
    ("Dallas", "TX"),
    ("San Jose", "CA"),
]
CATEGORY_PRICES = {
    "Electronics": (100, 2000),
    "Fashion": (20, 500),
    "Grocery": (1, 50),
    "Furniture": (50, 1500),
    "Sports": (10, 800),
}
GENDERS = ["M", "F", "Male", "Female", None]
PAYMENTS = ["Card", "UPI", "COD", "Crypto", None]
STATUSES = ["Delivered", "Cancelled", "Returned"]
FIRST_DAY = dt.date(2023, 1, 1)
LAST_DAY = dt.date(2026, 1, 1)
CUSTOMERS = 200_000
PRODUCTS = 50_000
CUSTOMER_PREFIX, PRODUCT_PREFIX = "CUST", "PROD"
SHIP_LAG = (-3, 10)
AGE, LOW_AGE, HIGH_AGE = (18, 70), (-10, 10), (120, 200)
QUANTITY, LOW_QUANTITY = (1, 10), (-5, -1)
REFUND = (1, 100)
DISCOUNT, HIGH_DISCOUNT = (0, 50), (60, 150)

ROWS_PER_TASK = 2_000_000

# The draws of a row; a draw's number is its position.
DRAWS = (
    "id_high",
    "id_low",
    "order_date",
    "ship_lag",
    "customer",
    "age_kind",
    "age",
    "gender",
    "category",
    "price_kind",
    "price",
    "quantity_kind",
    "quantity",
    "discount_kind",
    "discount",
    "place",
    "product",
    "payment",
    "status",
)


def synth_sales(
    spark: SparkSession,
    n: int,
    ingestion_date: dt.date,
    seed: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """``n`` dirty sales rows with about two rows per transaction id.

    The same ``n`` and ``seed`` give the same rows on any cluster, whatever the number
    of partitions; without one it follows ``n``.
    """
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    keys = spark.range(0, n, 1, partitions)
    return dirty_sales(keys, "id", F.lit(max(n // 2, 1)), ingestion_date, seed)


def dirty_sales(
    keys: DataFrame, key: str, ids: Column, ingestion_date: dt.date, seed: int = 0
) -> DataFrame:
    """One dirty sales row per row of ``keys``, with transaction ids ``1 .. ids``."""
    drawn = keys.select(
        *[draw(key, seed, number).alias(name) for number, name in enumerate(DRAWS)]
    )
    d = F.col
    categories = list(CATEGORY_PRICES)
    lows = [low * 100 for low, _ in CATEGORY_PRICES.values()]
    cents = [(high - low) * 100 + 1 for low, high in CATEGORY_PRICES.values()]
    list_price = pick(d("category"), lows) + d("price") % pick(d("category"), cents)
    least, most = map(float, REFUND)
    refund = F.lit(-least) - F.lit(most - least) * d("price") / F.lit(float(DRAW_SPAN))

    order_date = F.date_add(
        F.lit(FIRST_DAY),
        between(d("order_date"), 0, (LAST_DAY - FIRST_DAY).days).cast("int"),
    )
    columns = {
        "transaction_id": (wide(d("id_high"), d("id_low")) % ids + 1).cast("string"),
        "order_date": order_date,
        "ship_date": F.date_add(order_date, between(d("ship_lag"), *SHIP_LAG).cast("int")),
        "customer_id": _numbered(CUSTOMER_PREFIX, d("customer"), CUSTOMERS),
        "customer_age": _one_of(
            d("age_kind"),
            between(d("age"), *AGE),
            between(d("age"), *LOW_AGE),
            between(d("age"), *HIGH_AGE),
            F.lit(None),
        ),
        "gender": pick(d("gender"), GENDERS),
        "product_id": _numbered(PRODUCT_PREFIX, d("product"), PRODUCTS),
        "product_category": pick(d("category"), categories),
        "quantity": _one_of(
            d("quantity_kind"),
            between(d("quantity"), *QUANTITY),
            F.lit(0),
            between(d("quantity"), *LOW_QUANTITY),
        ),
        "unit_price": _one_of(
            d("price_kind"), _hundredths(list_price), refund, F.lit(None)
        ),
        "discount_pct": _one_of(
            d("discount_kind"),
            _hundredths(between(d("discount"), *(100 * x for x in DISCOUNT))),
            _hundredths(between(d("discount"), *(100 * x for x in HIGH_DISCOUNT))),
            F.lit(None),
        ),
        "city": pick(d("place"), [city for city, _ in PLACES]),
        "state": pick(d("place"), [state for _, state in PLACES]),
        "payment_type": pick(d("payment"), PAYMENTS),
        "order_status": pick(d("status"), STATUSES),
        "ingestion_date": F.lit(ingestion_date),
    }
    return drawn.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in RAW_SCHEMA]
    )


def _numbered(prefix: str, drawn: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), between(drawn, 1, n).cast("string"))


def _hundredths(whole: Column) -> Column:
    return whole.cast("double") / F.lit(100.0)


def _one_of(kind: Column, *options: Column) -> Column:
    """One of ``options`` with equal chance."""
    which = kind % len(options)
    chosen = F.when(which == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        chosen = chosen.when(which == i, option)
    return chosen
