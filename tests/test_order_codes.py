"""Several columns as one number: same order as the columns, nulls first, or none."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tallymart.functions.order_codes import order_code

EDGES = {
    "boolean": [None, False, True],
    "tinyint": [None, -128, -1, 0, 127],
    "smallint": [None, -32768, 0, 32767],
    "int": [None, -(2**31), -1, 0, 1, 2**31 - 1],
    "bigint": [None, -(2**63), -1, 0, 2**63 - 1],
    "date": [None, dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(9999, 12, 31)],
    "timestamp": [None, dt.datetime(1901, 1, 1), dt.datetime(1970, 1, 1), dt.datetime(9999, 1, 1)],
}


@pytest.mark.parametrize(
    "kinds",
    [("boolean", "tinyint", "smallint"), ("int", "date"), ("bigint", "int"), ("date", "timestamp"), ("int", "int", "int")],
)
def test_codes_sort_as_the_columns_do(spark, kinds):
    rows = list(itertools.product(*[EDGES[k] for k in kinds]))
    names = [f"c{at}" for at in range(len(kinds))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).coalesce(1)
    coded = df.select(*names, order_code(df, names).alias("code")).orderBy(*[F.asc_nulls_first(n) for n in names])
    codes = [r.code for r in coded.collect()]
    assert None not in codes and all(a < b for a, b in itertools.pairwise(codes))


def test_columns_that_do_not_fit_have_no_code(spark):
    df = spark.sql("SELECT 1 a, 2L b, 3L c, 'x' d, 1.5 e, 2.5F f, CURRENT_DATE() g")
    assert order_code(df, ["b", "c"]) is None  # 2 x 64 bits are more than 38 digits
    assert order_code(df, ["a", "g", "a", "g"]) is None
    for other in "def":
        assert order_code(df, ["a", other]) is None
    assert order_code(df, ["a", "b"]) is not None
