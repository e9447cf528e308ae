"""Report queries on top of the facts.

Each function takes facts that carry at least the keys it names - the stored
cube or any coarser facts, in either money mode - and rolls them up itself. Where
the input already has the wanted grain and partitioning, that adds no shuffle.
A figure that a row without price in cents goes into is NaN, not a sum of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import money
from tallymart.functions.global_windows import with_rank_desc, with_total
from tallymart.operators.marts import average_order_value, revenue, roll_up


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def kpi_category_totals(facts: DataFrame) -> DataFrame:
    """Total revenue, orders and units."""
    return roll_up(facts).select(
        revenue().alias("category_revenue"),
        F.col("orders").alias("total_orders"),
        F.col("units").alias("total_sold_units"),
    )


def category_order_share(facts: DataFrame) -> DataFrame:
    """Orders per category and their share of all orders."""
    by_category = roll_up(facts, "product_category").select("product_category", "orders")
    return with_total(by_category, "product_category", "orders", "all_orders").select(
        "product_category",
        F.col("orders").alias("order_count"),
        _ratio(F.col("orders"), F.col("all_orders")).alias("order_share"),
    )


def category_revenue_rank(facts: DataFrame) -> DataFrame:
    """Categories ranked by revenue, largest first."""
    by_category = roll_up(facts, "product_category").select(
        "product_category", revenue().alias("category_revenue")
    )
    return with_rank_desc(by_category, "category_revenue", "revenue_rank")


def category_units_revenue(facts: DataFrame) -> DataFrame:
    """Units sold beside revenue, per category."""
    return roll_up(facts, "product_category").select(
        "product_category",
        F.col("units").alias("total_units_sold"),
        revenue().alias("category_revenue"),
    )


def category_revenue_ratio(facts: DataFrame) -> DataFrame:
    """Revenue of the strongest and weakest category, and how many times larger."""
    extremes = roll_up(facts, "product_category").agg(
        F.max("amount").alias("top"),
        F.min("amount").alias("bottom"),
        F.sum("unpriceable").alias("unpriceable"),
    )
    return extremes.select(
        revenue("top").alias("top_revenue"),
        revenue("bottom").alias("bottom_revenue"),
        _ratio(revenue("top"), revenue("bottom")).alias("revenue_ratio"),
    )


def _by_month_of_year(facts: DataFrame) -> DataFrame:
    with_month = facts.withColumn("month", F.month("order_date"))
    return roll_up(with_month, "month")


def monthly_orders(facts: DataFrame) -> DataFrame:
    """Orders per month of the year, all years together."""
    return _by_month_of_year(facts).select("month", F.col("orders").alias("total_orders"))


def monthly_revenue(facts: DataFrame) -> DataFrame:
    """Revenue per month of the year, all years together."""
    return _by_month_of_year(facts).select("month", revenue().alias("total_revenue"))


def calendar_month_trend(facts: DataFrame) -> DataFrame:
    """Orders and revenue per calendar month: the trend over time."""
    with_month = facts.withColumn("month_start", F.trunc("order_date", "month"))
    return roll_up(with_month, "month_start").select(
        "month_start",
        F.col("orders").alias("total_orders"),
        revenue().alias("total_revenue"),
    )


def kpi_daily(facts: DataFrame) -> DataFrame:
    """Order total, the sum over days of the average order value, and the mean day's revenue.

    The sum of daily averages is what the report card "average daily revenue"
    shows; the mean over days with revenue is what that name says.
    """
    by_day = roll_up(facts, "order_date")
    average = money.rounded_average(F.col("amount"), F.col("priced_orders")).cast("decimal(28,2)")
    return (
        by_day.withColumn("aov", average)
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("aov").alias("aov_sum"),
            F.sum("amount").alias("amount"),
            F.count("amount").alias("days"),
            F.sum("unpriceable").alias("unpriceable"),
        )
        .select(
            "total_orders",
            revenue("aov_sum").alias("sum_of_daily_avg_order_value"),
            _mean("days").alias("mean_daily_revenue"),
        )
    )


def _mean(count: str) -> Column:
    """``amount`` by a count of its groups, NaN if a row in it could not be priced."""
    mean = money.rounded_average(F.col("amount"), F.col(count))
    return F.when(F.col("unpriceable") > 0, F.lit(float("nan"))).otherwise(mean)


def state_metrics(facts: DataFrame) -> DataFrame:
    """Revenue, orders, cities and average order value per state.

    The average is amount over priced orders of the whole state, not an
    average of city averages.
    """
    by_city = roll_up(facts, "city", "state").withColumn("cities", F.lit(1))
    by_state = by_city.groupBy("state").agg(
        F.sum("amount").alias("amount"),
        F.sum("priced_orders").alias("priced_orders"),
        F.sum("unpriceable").alias("unpriceable"),
        F.sum("orders").alias("order_count"),
        F.sum("cities").alias("city_count"),
    )
    return by_state.select(
        "state",
        revenue().alias("state_revenue"),
        "order_count",
        "city_count",
        average_order_value().alias("avg_order_value"),
    )


def kpi_states(facts: DataFrame) -> DataFrame:
    """Number of states, and mean revenue per city and per state.

    The report card "average revenue per state" shows the mean over city rows;
    both are given under their own name. A null state is no state, but its
    revenue is part of the total.
    """
    by_state = (
        roll_up(facts, "city", "state")
        .groupBy("state")
        .agg(
            F.sum("amount").alias("amount"),
            F.count("amount").alias("priced_cities"),
            F.sum("unpriceable").alias("unpriceable"),
        )
    )
    return by_state.agg(
        F.count("state").alias("total_states"),
        F.sum("amount").alias("amount"),
        F.sum("priced_cities").alias("priced_cities"),
        F.count("amount").alias("priced_states"),
        F.sum("unpriceable").alias("unpriceable"),
    ).select(
        "total_states",
        _mean("priced_cities").alias("avg_revenue_per_city_row"),
        _mean("priced_states").alias("avg_revenue_per_state"),
    )


def city_revenue_bubble(facts: DataFrame) -> DataFrame:
    """City, state and revenue."""
    return roll_up(facts, "city", "state").select(
        "city", "state", revenue().alias("city_revenue")
    )


#: Every report, in the order of the definitions.
REPORTS = (
    kpi_category_totals,
    category_order_share,
    category_revenue_rank,
    category_units_revenue,
    category_revenue_ratio,
    monthly_orders,
    monthly_revenue,
    calendar_month_trend,
    kpi_daily,
    state_metrics,
    kpi_states,
    city_revenue_bubble,
)
