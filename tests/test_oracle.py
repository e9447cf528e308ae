"""Every registered query against its SQL, by value."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from checks import star_sql
from tests.compare import assert_same, duck
from tests.conftest import TESTDATA

FOLDER = TESTDATA / "sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(star_sql.registered()))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, str(FOLDER))
    assert assert_same(df, con, registry.oracle_sql()[name]) > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_has_rows_and_the_mart_schema(spark):
    df = registry.entry(spark)
    assert df.columns == [
        "order_date",
        "daily_total_revenue",
        "daily_total_orders",
        "daily_avg_order_value",
    ]
    assert df.count() > 0
