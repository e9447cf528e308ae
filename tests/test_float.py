"""Float-mode marts against a plain computation over the collected rows."""

from __future__ import annotations

import struct
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest

import __spark_entry__ as registry
from tests.conftest import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")


def single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def amount(r) -> float | None:
    if r.unit_price is None or r.discount_pct is None:
        return None
    value = single(single(r.quantity) * single(r.unit_price)) * (1 - r.discount_pct / 100)
    return float(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))


@pytest.fixture(scope="module")
def silver(spark):
    return registry.queries()["silver_clean"](spark, FOLDER).collect()


def grouped(silver, *keys):
    groups = defaultdict(list)
    for r in silver:
        groups[tuple(r[k] for k in keys)].append(r)
    for key, members in groups.items():
        priced = [a for a in map(amount, members) if a is not None]
        revenue = sum(priced) if priced else None
        yield key, revenue, members, revenue / len(priced) if priced else None


def close(got, want):
    return got is None if want is None else got == pytest.approx(want, abs=0.0051)


def run(spark, name, keys):
    rows = registry.queries()[name](spark, FOLDER).collect()
    found = {tuple(r[k] for k in keys): r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(
    "name, keys, revenue, orders, average, units",
    [
        (
            "daily_sales_metrics_float",
            ("order_date",),
            "daily_total_revenue",
            "daily_total_orders",
            "daily_avg_order_value",
            None,
        ),
        (
            "product_category_performance_float",
            ("product_category",),
            "category_revenue",
            "order_count",
            None,
            "total_units_sold",
        ),
        (
            "city_revenue_metrics_float",
            ("city", "state"),
            "city_revenue",
            "order_count",
            "avg_order_value",
            None,
        ),
    ],
)
def test_float_marts(spark, silver, name, keys, revenue, orders, average, units):
    found = run(spark, name, keys)
    want = list(grouped(silver, *keys))
    assert found.keys() == {key for key, *_ in want}
    for key, total, members, mean in want:
        r = found[key]
        assert close(r[revenue], total) and r[orders] == len(members)
        if average:
            assert close(r[average], mean)
        if units:
            assert r[units] == sum(m.quantity for m in members)
