"""Each query with SQL against that SQL, by value and type."""

from __future__ import annotations

import duckdb
import pytest

from tallymart.llm import queries, sql
from tests.compare import assert_same
from tests.conftest import TESTDATA

TABLES = ("documents", "pages", "labels", "conversations")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(sql.registered()))
def test_matches_sql(spark, name, size):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA / size / table}.parquet'")
    df = queries.registered()[name](spark, str(TESTDATA / size))
    assert assert_same(df, con, sql.registered()[name]) > 0
