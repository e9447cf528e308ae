"""The measure, the additive sales facts and the three published marts.

Facts are a table of group keys with sums that can be added up again: amount,
priced orders, orders and units. ``facts`` builds them from cleaned rows and
``roll_up`` from finer facts, so every mart and report can be derived either
straight from the rows or from one stored cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import money
from tallymart.schema import BUSINESS_KEY

MEASURES = ("amount", "priced_orders", "unpriceable", "orders", "units")
CUBE_KEYS = ("order_date", "product_category", "city", "state")


def with_total_amount(silver: DataFrame, mode: str = money.EXACT) -> DataFrame:
    """Add ``total_amount``: quantity times price less discount, to the cent.

    Null if any input is null. ``exact`` is decimal arithmetic on the digits of
    the inputs; ``float`` is the binary floating-point formula to the last bit of it.
    """
    formulas = {money.EXACT: money.exact_amount, money.FLOAT: money.float_amount}
    amount = formulas[mode]("quantity", "unit_price", "discount_pct")
    return silver.withColumn("total_amount", amount)


PRICED_FROM = ("quantity", "unit_price", "discount_pct")


def facts(rows: DataFrame, *keys: str) -> DataFrame:
    """Additive measures of cleaned rows with ``total_amount``, one row per ``keys``.

    ``orders`` counts rows with a transaction id, ``priced_orders`` rows with
    an amount, ``unpriceable`` rows whose inputs are there but give no number of
    cents. Amounts are summed as exact cents in either mode, so a sum does not
    depend on partitions. The sums combine per map task before the shuffle, so a
    key that holds most rows sends one row per task like any other.
    """
    return rows.groupBy(*keys).agg(
        F.sum(money.in_cents("total_amount")).alias("amount"),
        F.count("total_amount").alias("priced_orders"),
        F.count_if(money.unpriceable("total_amount", *PRICED_FROM)).alias("unpriceable"),
        F.count(BUSINESS_KEY).alias("orders"),
        F.sum("quantity").alias("units"),
    )


def _added_up() -> list[Column]:
    return [F.sum(measure).alias(measure) for measure in MEASURES]


def roll_up(finer: DataFrame, *keys: str) -> DataFrame:
    """Facts at a coarser grain from finer facts."""
    return finer.groupBy(*keys).agg(*_added_up())


def roll_ups(finer: DataFrame, grains: Sequence[Sequence[str]]) -> DataFrame:
    """Facts at several coarser grains in one pass over the finer ones.

    A row for each group of each grain, with the number of its grain in ``grain``; keys
    that the grain does not have are null. :func:`at_grain` takes one out. A grain without
    keys has no row if there are no facts.
    """
    keys = list(dict.fromkeys(key for grain in grains for key in grain))
    # grouping_id() has a bit for each key, the first key's highest, set where the grain lacks it
    ids = [sum((key not in grain) << at for at, key in enumerate(reversed(keys))) for grain in grains]
    number = F.create_map(*[F.lit(v) for pair in zip(ids, range(len(grains))) for v in pair])
    return (
        finer.groupingSets([list(grain) for grain in grains], *keys)
        .agg(*_added_up(), F.grouping_id().cast("int").alias("grain"))
        .withColumn("grain", number[F.col("grain")])
    )


def at_grain(several: DataFrame, grains: Sequence[Sequence[str]], number: int) -> DataFrame:
    """The facts of one grain of ``roll_ups``, as ``roll_up`` gives them."""
    return several.where(F.col("grain") == number).select(*grains[number], *MEASURES)


def revenue(amount: str = "amount") -> Column:
    """The published revenue of a row of facts."""
    return money.published(F.col(amount), F.col("unpriceable"))


def sales_cube(rows: DataFrame) -> DataFrame:
    """Facts by day, category and place: the one table all marts and reports follow from."""
    return facts(rows, *CUBE_KEYS)


def average_order_value() -> Column:
    """Amount per priced order, to the cent; null where nothing was priced, NaN if a row could not be."""
    average = money.rounded_average(F.col("amount"), F.col("priced_orders"))
    return F.when(F.col("unpriceable") > 0, F.lit(float("nan"))).otherwise(average)


def daily_mart(by_day: DataFrame) -> DataFrame:
    """Revenue, orders and average order value per day, from facts by ``order_date``."""
    return by_day.select(
        "order_date",
        revenue().alias("daily_total_revenue"),
        F.col("orders").alias("daily_total_orders"),
        average_order_value().alias("daily_avg_order_value"),
    )


def category_mart(by_category: DataFrame) -> DataFrame:
    """Revenue, units and orders per category, from facts by ``product_category``."""
    return by_category.select(
        "product_category",
        revenue().alias("category_revenue"),
        F.col("units").alias("total_units_sold"),
        F.col("orders").alias("order_count"),
    )


def city_mart(by_city: DataFrame) -> DataFrame:
    """Revenue, orders and average order value per city, from facts by ``city, state``."""
    return by_city.select(
        "city",
        "state",
        revenue().alias("city_revenue"),
        F.col("orders").alias("order_count"),
        average_order_value().alias("avg_order_value"),
    )
