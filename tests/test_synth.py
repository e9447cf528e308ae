"""The generator: distributions, and the published totals at full size."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymart import category_mart, clean, facts, roll_up, sales_cube, synth_sales
from tallymart import RAW_SCHEMA, assert_schema, with_total_amount
from tallymart.operators import rollups
from tallymart.sources.synthetic import CATEGORY_PRICES, DISCOUNT, HIGH_DISCOUNT, PLACES, QUANTITY

ROWS = 400_000
TODAY = dt.date(2026, 1, 1)

# Totals published for the 4,000,000-row feed.
PUBLISHED_ROWS = 4_000_000
ORDERS, UNITS, REVENUE = 577_000, 3_172_350, 150.78e6
CATEGORY_REVENUE = {
    "Electronics": 62.86e6,
    "Furniture": 46.72e6,
    "Sports": 24.20e6,
    "Fashion": 15.51e6,
    "Grocery": 1.49e6,
}
SUM_OF_DAILY_AVERAGES = 1.78e6
REVENUE_PER_CITY_ROW = 15.08e6


@pytest.fixture(scope="module")
def raw(spark):
    return assert_schema(synth_sales(spark, ROWS, TODAY), RAW_SCHEMA).cache()


def shares(df, column):
    return {r[0]: r[1] / ROWS for r in df.groupBy(column).count().collect()}


def evenly(found, values, tolerance=0.005):
    assert found.keys() == set(values)
    for share in found.values():
        assert share == pytest.approx(1 / len(values), abs=tolerance)


def test_labels_are_uniform(raw):
    evenly(shares(raw, "gender"), ["M", "F", "Male", "Female", None])
    evenly(shares(raw, "payment_type"), ["Card", "UPI", "COD", "Crypto", None])
    evenly(shares(raw, "order_status"), ["Delivered", "Cancelled", "Returned"])
    evenly(shares(raw, "product_category"), CATEGORY_PRICES)
    evenly(shares(raw.withColumn("p", F.concat_ws("|", "city", "state")), "p"),
           ["|".join(p) for p in PLACES])


def test_draws_of_a_row_are_independent(raw):
    """Chi-square of pairs of labels; 4 standard deviations around its mean."""
    columns = ["gender", "payment_type", "order_status", "product_category"]
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            cells = raw.groupBy(a, b).count().collect()
            expected = ROWS / len(cells)
            chi = sum((c["count"] - expected) ** 2 / expected for c in cells)
            freedom = len(cells) - 1
            assert abs(chi - freedom) < 4 * (2 * freedom) ** 0.5, (a, b, chi)


def test_ranges_and_defects(raw):
    r = raw.agg(
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
        F.count_distinct("order_date").alias("days"),
        F.min(F.date_diff("ship_date", "order_date")).alias("lag_low"),
        F.max(F.date_diff("ship_date", "order_date")).alias("lag_high"),
        F.avg((F.col("ship_date") < F.col("order_date")).cast("int")).alias("early"),
        F.count_distinct("transaction_id").alias("ids"),
        F.max(F.col("transaction_id").cast("bigint")).alias("top_id"),
        F.min("quantity").alias("q_low"),
        F.max("quantity").alias("q_high"),
        F.avg((F.col("quantity") > 0).cast("int")).alias("q_good"),
        F.avg((F.col("quantity") == 0).cast("int")).alias("q_zero"),
        F.avg(F.col("unit_price").isNull().cast("int")).alias("p_null"),
        F.avg((F.coalesce(F.col("unit_price"), F.lit(1)) < 0).cast("int")).alias("p_negative"),
        F.min("unit_price").alias("p_low"),
        F.max("unit_price").alias("p_high"),
        F.max("discount_pct").alias("d_high"),
        F.avg(F.col("discount_pct").between(50.01, 59.99).cast("int")).alias("d_gap"),
        F.avg(F.col("discount_pct").isNull().cast("int")).alias("d_null"),
        F.avg(F.col("customer_age").isNull().cast("int")).alias("a_null"),
        (F.count_if(F.col("customer_age").between(18, 70)) / ROWS).alias("a_good"),
        F.min("customer_age").alias("a_low"),
        F.max("customer_age").alias("a_high"),
        F.min("ingestion_date").alias("ingested"),
    ).first()
    assert (r["first"], r["last"], r.days) == (dt.date(2023, 1, 1), TODAY, 1097)
    assert (r.lag_low, r.lag_high) == (-3, 10)
    assert r.early == pytest.approx(3 / 14, abs=0.003)
    assert r.top_id <= ROWS // 2
    assert r.ids == pytest.approx(ROWS / 2 * (1 - 2.718281828**-2), rel=0.005)
    assert (r.q_low, r.q_high) == (-5, 10)
    assert r.q_good == pytest.approx(1 / 3, abs=0.004)
    assert r.q_zero == pytest.approx(1 / 3, abs=0.004)
    assert r.p_null == pytest.approx(1 / 3, abs=0.004)
    assert r.p_negative == pytest.approx(1 / 3, abs=0.004)
    assert -100 <= r.p_low < -99.9 and 1999 < r.p_high <= 2000
    assert 149 < r.d_high <= 150 and r.d_gap == 0
    assert r.d_null == pytest.approx(1 / 3, abs=0.004)
    assert r.a_null == pytest.approx(1 / 4, abs=0.004)
    assert r.a_good == pytest.approx(1 / 4, abs=0.004)
    assert (r.a_low, r.a_high) == (-10, 200)
    assert r.ingested == TODAY


def expected_revenue(category: str, orders: int) -> tuple[float, float]:
    """Mean and standard error of a category's revenue over so many clean orders.

    An order is of the category with chance 1/5 and priced with chance 1/3; of the
    discounts that are there (2/3), the high ones count up to 100. Quantity, price and
    discount are uniform and independent.
    """

    def moment(low: float, high: float, power: int) -> float:
        return (high ** (power + 1) - low ** (power + 1)) / (power + 1) / (high - low)

    def paid(power: int) -> float:
        """The mean of (1 - discount) ** power, with 0 for rows without a valid discount."""
        low, high = (tuple(x / 100 for x in span) for span in (DISCOUNT, HIGH_DISCOUNT))
        valid = (1 - high[0]) / (high[1] - high[0])
        return (moment(1 - low[1], 1 - low[0], power) + valid * moment(0, 1 - high[0], power)) / 3

    quantities = range(QUANTITY[0], QUANTITY[1] + 1)
    first, second = (
        sum(q**k for q in quantities) / len(quantities) * moment(*CATEGORY_PRICES[category], k) / 3 * paid(k)
        for k in (1, 2)
    )
    share = 1 / len(CATEGORY_PRICES)
    return orders * share * first, (orders * (share * second - (share * first) ** 2)) ** 0.5


def assert_expected(category: str, revenue: float, orders: int) -> None:
    mean, error = expected_revenue(category, orders)
    assert abs(revenue - mean) < 4 * error, (category, revenue, mean, error)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_revenue_of_a_category_is_as_drawn(spark, seed):
    silver = clean(synth_sales(spark, ROWS, TODAY, seed))
    cube = sales_cube(with_total_amount(silver)).cache()
    orders = rollups.kpi_category_totals(cube).first().total_orders
    assert orders == pytest.approx(ROWS / 2 * (1 - 2.718281828**-2) / 3, rel=0.015)
    for r in category_mart(roll_up(cube, "product_category")).collect():
        assert_expected(r.product_category, float(r.category_revenue), orders)


def test_published_totals_at_full_size(spark):
    """Both feeds are random: totals within 3 %, a category's revenue within 4 standard errors of its mean."""
    silver = clean(synth_sales(spark, PUBLISHED_ROWS, TODAY, partitions=16))
    cube = sales_cube(with_total_amount(silver)).cache()
    totals = rollups.kpi_category_totals(cube).first()
    assert totals.total_orders == pytest.approx(ORDERS, rel=0.01)
    assert totals.total_sold_units == pytest.approx(UNITS, rel=0.01)
    assert totals.category_revenue == pytest.approx(REVENUE, rel=0.03)
    categories = category_mart(roll_up(cube, "product_category")).collect()
    assert len(categories) == len(CATEGORY_REVENUE)
    for r in categories:
        assert_expected(r.product_category, float(r.category_revenue), totals.total_orders)
        assert_expected(r.product_category, CATEGORY_REVENUE[r.product_category], ORDERS)
    ranked = rollups.category_revenue_rank(cube).orderBy("revenue_rank").collect()
    assert [r.product_category for r in ranked] == list(CATEGORY_REVENUE)
    daily = rollups.kpi_daily(cube).first()
    assert daily.total_orders == totals.total_orders
    assert daily.sum_of_daily_avg_order_value == pytest.approx(SUM_OF_DAILY_AVERAGES, rel=0.03)
    states = rollups.kpi_states(cube).first()
    assert states.total_states == 6
    assert states.avg_revenue_per_city_row == pytest.approx(REVENUE_PER_CITY_ROW, rel=0.03)
    months = {r.month: r.total_orders for r in rollups.monthly_orders(cube).collect()}
    assert len(months) == 12 and min(months, key=months.get) == 2
    assert all(44_000 <= n <= 50_500 for n in months.values())
