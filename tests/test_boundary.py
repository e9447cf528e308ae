"""Every edge of every rule, on hand-written rows with known answers."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart import (
    SALES_RULES,
    apply_rules,
    category_mart,
    city_mart,
    clean,
    daily_mart,
    dq_report,
    facts,
    read_raw_csv,
    with_total_amount,
)
from tallymart.operators.rules import rule
from tests import rows


@pytest.fixture(scope="module", params=["true", "false"], ids=["ansi", "no-ansi"])
def session(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.fixture(scope="module")
def bronze(session, tmp_path_factory):
    return read_raw_csv(session, rows.write_csv(tmp_path_factory.mktemp("raw")))


@pytest.fixture(scope="module")
def silver(bronze):
    return with_total_amount(clean(bronze, rows.ORDER))


def same(got, want):
    if isinstance(want, float) and math.isnan(want):
        return isinstance(got, float) and math.isnan(got)
    if isinstance(want, float):
        return got is not None and math.isclose(got, want, rel_tol=1e-7)
    return got == want


def test_bad_cells_are_null_and_rows_are_kept(bronze):
    got = {r.transaction_id: r for r in bronze.collect()}
    assert bronze.count() == len(rows.BOUNDARY)
    assert got["e05"].order_date is None
    assert got["e07"].customer_age is None
    assert got["e09"].quantity is None
    assert got["e04"].gender == " female "


def test_silver_rows(silver):
    got = {r.transaction_id: r for r in silver.collect()}
    assert got.keys() == rows.SILVER.keys()
    for tid, want in rows.SILVER.items():
        r = got[tid]
        values = (
            r.order_date,
            r.ship_date,
            r.customer_age,
            r.gender,
            r.quantity,
            r.unit_price,
            r.discount_pct,
            r.payment_type,
        )
        assert all(map(same, values, want)), (tid, values)
        amount = want[-1] and Decimal(want[-1])
        assert r.total_amount == amount, tid


def test_rules_alone_on_rows_that_cleaning_drops(bronze):
    got = {
        r.transaction_id: r
        for r in apply_rules(bronze, [rule("gender"), rule("payment_type")]).collect()
    }
    assert got["e06"].gender is None  # "M " is not a code
    assert got["e07"].gender == "F"
    assert got["e07"].payment_type is None  # "Card " is not a type
    assert got["e04"].payment_type is None


def test_marts(silver):
    daily = {r[0]: tuple(r[1:]) for r in daily_mart(facts(silver, "order_date")).collect()}
    assert daily == rows.DAILY
    by_category = facts(silver, "product_category")
    category = {r[0]: tuple(r[1:]) for r in category_mart(by_category).collect()}
    assert category == rows.CATEGORY
    city = {(r[0], r[1]): tuple(r[2:]) for r in city_mart(facts(silver, "city", "state")).collect()}
    assert city == rows.CITY


def test_dq_report_counts(bronze):
    got = {r.rule: (r.rows_checked, r.rows_violating, r.rows_null) for r in
           dq_report(bronze, "transaction_id").collect()}
    assert got == {
        "duplicate_key": (14, 1, 2),
        "ship_date": (14, 1, 1),
        "quantity": (14, 4, 2),
        "unit_price": (14, 2, 1),
        "discount": (14, 3, 1),
        "customer_age": (14, 3, 2),
        "gender": (14, 6, 0),
        "payment_type": (14, 3, 1),
    }


def test_two_rules_on_one_column_are_refused(bronze):
    with pytest.raises(ValueError, match="more than one rule"):
        apply_rules(bronze, [*SALES_RULES, rule("gender")])


def test_amounts_round_half_up_and_survive_absurd_prices(session):
    df = session.sql(
        """SELECT * FROM VALUES
        (1, CAST(10.05 AS FLOAT), CAST(50 AS FLOAT)),
        (3, CAST(19.99 AS FLOAT), CAST(10.5 AS FLOAT)),
        (2147483647, CAST(1e30 AS FLOAT), CAST(0 AS FLOAT)),
        (1, CAST('Infinity' AS FLOAT), CAST(0 AS FLOAT)),
        (2147483647, CAST(9999999 AS FLOAT), CAST(0 AS FLOAT)),
        (2147483647, CAST(999999 AS FLOAT), CAST(0 AS FLOAT)),
        (1, CAST(NULL AS FLOAT), CAST(0 AS FLOAT))
        AS t(quantity, unit_price, discount_pct)"""
    )
    exact = [r.total_amount for r in with_total_amount(df).collect()]
    assert exact == [
        Decimal("5.03"),
        Decimal("53.67"),
        None,  # above 1e26
        None,
        Decimal(2147483647 * 9999999),
        Decimal(2147483647 * 999999),
        None,
    ]
    floats = [r.total_amount for r in with_total_amount(df, "float").collect()]
    assert floats[:2] == [5.03, 53.67]
    assert math.isinf(floats[3])
    assert floats[6] is None


def test_amounts_keep_the_digits_of_their_inputs(session):
    df = session.sql(
        """SELECT 0 AS n, t.* FROM VALUES
        (1000, CAST(19.995 AS FLOAT), CAST(0 AS FLOAT)),
        (100, CAST(99.99 AS FLOAT), CAST(12.345 AS FLOAT)),
        (1, CAST(2e10 AS FLOAT), CAST(0 AS FLOAT)),
        (7, CAST(0.004 AS FLOAT), CAST(10 AS FLOAT))
        AS t(quantity, unit_price, discount_pct)"""
    )
    found = [r.total_amount for r in with_total_amount(df).collect()]
    assert found == [Decimal("19995.00"), Decimal("8764.62"), Decimal("20000000000.00"), Decimal("0.03")]
    many = session.range(1000).crossJoin(df.where("quantity = 7")).withColumn("transaction_id", F.lit("t"))
    assert facts(with_total_amount(many), "n").first().amount == Decimal("30.00")


def test_float_mode_keeps_nan_in_the_sums(session, bronze):
    silver = with_total_amount(clean(bronze, rows.ORDER), "float")
    nan_row = silver.withColumn("discount_pct", F.lit(0.0).cast("float"))
    nan_row = with_total_amount(nan_row.drop("total_amount"), "float")
    got = {r[0]: r[1] for r in daily_mart(facts(nan_row, "order_date")).collect()}
    assert math.isnan(got[rows.D11])
