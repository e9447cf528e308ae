"""Exact comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")


def duck(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(kind: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(kind) else str(kind)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Same columns and types, and the same rows value by value; returns their number."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    got, want = got.select(names), want.select(names)
    assert [_plain(f.type) for f in got.schema] == [_plain(f.type) for f in want.schema]
    left, right = _rows(got), _rows(want)
    assert left.total() == right.total()
    missing, extra = right - left, left - right
    assert not missing and not extra, (
        f"{missing.total()} rows differ, e.g. expected {list(missing)[:3]},"
        f" got {list(extra)[:3]}"
    )
    return left.total()


def _rows(table: pa.Table) -> Counter:
    return Counter(zip(*(map(repr, c.to_pylist()) for c in table.columns)))
