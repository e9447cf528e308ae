"""Properties that hold whatever the data: consistency, determinism, idempotence."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymart import clean, dedup, dq_report, duplicate_keys, facts, roll_up, sales_cube
from tallymart import synth_sales, with_total_amount
from tallymart.functions.money import rounded_average
from tallymart.functions.global_windows import running_total, with_rank_desc, with_total
from tallymart.operators import rollups
from tallymart.operators.dedup import FINGERPRINT, with_order
from tallymart.operators.marts import at_grain, roll_ups
from tallymart.operators.rules import SALES_RULES
from tallymart.plans.pipeline import MART_GRAINS
from tallymart.plans.silver import layer_counts, surviving_copies
from tallymart.schema import RAW_COLUMNS

MEASURES = ["amount", "priced_orders", "orders", "units"]


@pytest.fixture(scope="module")
def bronze(spark):
    return synth_sales(spark, 20_000, dt.date(2026, 1, 1), seed=3, partitions=7).cache()


@pytest.fixture(scope="module")
def rows(bronze):
    return with_total_amount(clean(bronze)).cache()


def as_set(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_all_grains_have_the_same_totals(rows):
    cube = sales_cube(rows)
    totals = {
        tuple(roll_up(grain).select(*MEASURES).first())
        for grain in [
            facts(rows, "order_date"),
            facts(rows, "product_category"),
            facts(rows, "city", "state"),
            facts(rows),
            cube,
            roll_up(cube, "city", "state"),
        ]
    }
    assert len(totals) == 1


@pytest.mark.parametrize(
    "keys", [("order_date",), ("product_category",), ("city", "state")]
)
def test_facts_from_the_cube_equal_facts_from_rows(rows, keys):
    columns = [*keys, *MEASURES]
    direct = as_set(facts(rows, *keys).select(*columns))
    assert as_set(roll_up(sales_cube(rows), *keys).select(*columns)) == direct


@pytest.mark.parametrize(
    "report",
    [
        rollups.kpi_category_totals,
        rollups.category_order_share,
        rollups.category_revenue_rank,
        rollups.category_units_revenue,
        rollups.category_revenue_ratio,
        rollups.monthly_orders,
        rollups.monthly_revenue,
        rollups.calendar_month_trend,
        rollups.kpi_daily,
        rollups.state_metrics,
        rollups.kpi_states,
        rollups.city_revenue_bubble,
    ],
)
def test_reports_take_the_cube_as_well_as_coarser_facts(rows, report):
    keys = {"cat": ("product_category",), "sta": ("city", "state"), "cit": ("city", "state")}
    name = report.__name__.removeprefix("kpi_")
    coarse = facts(rows, *keys.get(name[:3], ("order_date",)))
    assert as_set(report(sales_cube(rows))) == as_set(report(coarse))


def test_silver_ids_are_unique_and_all_orders_counted(rows):
    assert rows.count() == rows.select("transaction_id").distinct().count()
    assert rows.count() == facts(rows).first().orders


def test_cleaning_twice_changes_nothing(spark, rows):
    silver = rows.drop("total_amount")
    assert as_set(clean(silver)) == as_set(silver)


def test_survivors_do_not_depend_on_partitioning(bronze, rows):
    silver = as_set(rows.drop("total_amount"))
    for shuffled in (
        bronze.repartition(3),
        bronze.repartitionByRange(11, "ship_date"),
        bronze.orderBy(F.desc("customer_id")),
    ):
        assert as_set(clean(shuffled)) == silver


def test_generated_rows_do_not_depend_on_partitioning(spark, bronze):
    again = synth_sales(spark, 20_000, dt.date(2026, 1, 1), seed=3, partitions=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, bronze.collect()))
    other = synth_sales(spark, 20_000, dt.date(2026, 1, 1), seed=4)
    assert other.exceptAll(bronze).count() > 19_000


def first_copies(rows, order):
    """Brute force: the smallest row per id, nulls first."""

    def rank(row):
        return [(row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in order]

    groups = defaultdict(list)
    for row in rows:
        groups[row["id"]].append(row)
    return {key: min(copies, key=rank) for key, copies in groups.items()}


cell = st.one_of(st.none(), st.integers(-2, 2))
ids = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(ids, cell, cell), min_size=1, max_size=30))
def test_dedup_against_brute_force(spark, data):
    df = spark.createDataFrame(data, "id string, a int, b int").repartition(4)
    rows = [dict(zip(("id", "a", "b"), r)) for r in data]
    want = {k: (v["a"], v["b"]) for k, v in first_copies(rows, ["a", "b"]).items()}
    got = [(r.id, (r.a, r.b)) for r in dedup(df, "id", ["a", "b"]).collect()]
    assert len(got) == len(want) and dict(got) == want
    any_copy = [tuple(r) for r in dedup(df, "id").collect()]
    assert len(any_copy) == len(want) and set(any_copy) <= set(data)
    assert sorted(map(str, any_copy)) == sorted(
        str(tuple(r)) for r in dedup(df.repartition(2, "b"), "id").collect()
    )
    counts = defaultdict(int)
    for r in data:
        counts[r[0]] += 1
    reported = {r.id: r.copies for r in duplicate_keys(df, "id").collect()}
    assert reported == {k: n for k, n in counts.items() if n > 1}


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(st.none(), st.decimals(-(10**9), 10**9, places=2)), min_size=1, max_size=40
    )
)
def test_rank_and_total_against_brute_force(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v decimal(28,2)").repartition(4)
    got = {r.id: r.rank for r in with_rank_desc(df, "v", "rank").collect()}
    known = [v for v in values if v is not None]
    for i, v in rows:
        ahead = sum(o > v for o in known) if v is not None else len(known)
        assert got[i] == ahead + 1
    totals = with_total(df, "id", "v", "total").collect()
    assert sorted(r.id for r in totals) == [i for i, _ in rows]
    assert {r.total for r in totals} == {sum(known) if known else None}


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_running_total_against_brute_force(spark, partitions):
    rows = [(k * 7919 % 200 - 100 or None, chr(97 + k % 5), None if k % 11 == 0 else k) for k in range(200)]
    df = spark.createDataFrame(rows, "a long, b string, n long").repartition(7)
    found = running_total(df, [F.asc_nulls_first("a"), F.asc("b")], "n", "ahead", partitions).collect()
    total = 0
    want = []
    for a, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((a, b, n, total))
        total += n or 0
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert running_total(df.limit(0), [F.asc("a")], "n", "ahead", partitions).collect() == []


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(st.integers(-(10**15), 10**15), st.integers(0, 9)), min_size=1))
def test_average_is_exact_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "cents bigint, n bigint").select(
        "cents",
        "n",
        rounded_average(F.expr("cast(cents * 0.01 as decimal(28,2))"), F.col("n")).alias("avg"),
    )
    for r in df.collect():
        if r.n == 0:
            assert r.avg is None
            continue
        whole = (2 * abs(r.cents) + r.n) // (2 * r.n)
        assert r.avg == (whole if r.cents >= 0 else -whole) / 100


def test_the_default_survivor_tells_rows_apart_by_which_values_are_null(spark):
    rows = [("x", None, 1), ("x", 1, None), ("x", None, None)]
    df = spark.createDataFrame(rows, "id string, a int, b int")
    marks = with_order(df, "id")[0].select(FINGERPRINT).distinct()
    assert marks.count() == 3


def test_the_default_survivor_favours_no_date(spark):
    df = synth_sales(spark, 200_000, dt.date(2026, 1, 1), seed=5)
    middle = dt.date(2024, 7, 1)
    early = (F.col("order_date") <= middle).cast("int")
    share = df.agg(F.avg(early)).first()[0]
    kept = dedup(df, "transaction_id").agg(F.avg(early)).first()[0]
    assert kept == pytest.approx(share, abs=0.006)


def test_layer_counts_equal_the_rows_of_the_layers(bronze, rows):
    got = layer_counts(bronze).first()
    survivors = surviving_copies(bronze).count()
    assert tuple(got) == (bronze.count(), survivors, rows.count())


def test_rows_to_be_dropped_still_suppress_their_copies(spark):
    df = synth_sales(spark, 5_000, dt.date(2026, 1, 1), seed=9)
    narrow = ["order_date", "ship_date", "customer_id", "product_id", "quantity"]
    plain = dedup(df, "transaction_id", narrow).where("quantity > 0")
    light = surviving_copies(df, narrow).where("not _dropped").drop("_dropped")
    assert as_set(light) == as_set(plain)


def test_layer_counts_keep_copies_with_nothing_to_order_by(spark):
    """Nulls in a single ordering column come first, here as in the layers."""
    shipped = dt.date(2024, 1, 9)
    copies = [("all", None, 1), ("all", None, 1), ("mixed", None, 0), ("mixed", shipped, 1), ("one", shipped, 1)]
    base = synth_sales(spark, 10, dt.date(2026, 1, 1), partitions=1).limit(1).drop("transaction_id", "ship_date", "quantity")
    own = spark.createDataFrame(copies, "transaction_id string, ship_date date, quantity int")
    df = own.crossJoin(base).select(*RAW_COLUMNS)
    silver = clean(df, ["ship_date"])
    assert {r.transaction_id for r in silver.collect()} == {"all", "one"}
    assert tuple(layer_counts(df, ["ship_date"]).first()) == (5, surviving_copies(df, ["ship_date"]).count(), 2)


@pytest.mark.parametrize(
    "order_by",
    [["order_date", "ship_date"], ["quantity", "city", "discount_pct", *RAW_COLUMNS], ["ship_date", "quantity", "order_date"]],
)
def test_layer_counts_under_any_order_equal_the_layers(bronze, order_by):
    """Orders that fit one number and orders that do not; the last of them leaves no ties."""
    whole = [*order_by, *RAW_COLUMNS]
    for columns in (order_by, whole):
        survivors = surviving_copies(bronze, columns)
        got = tuple(layer_counts(bronze, columns).first())
        assert got[:2] == (bronze.count(), survivors.count())
    assert got[2] == survivors.where("not _dropped").count()


@pytest.mark.parametrize("rows_kept", [0, 1, None])
def test_several_grains_at_once_equal_each_alone(rows, rows_kept):
    """Keys that are null in the data stay apart from keys that a grain lacks."""
    holes = rows.withColumn("city", F.when(F.col("quantity") > 1, F.col("city")))
    cube = sales_cube(holes if rows_kept is None else holes.limit(rows_kept))
    several = roll_ups(cube, MART_GRAINS)
    for at, grain in enumerate(MART_GRAINS):
        alone = roll_up(cube, *grain)
        if not grain:
            alone = alone.where("orders IS NOT NULL")
        assert as_set(at_grain(several, MART_GRAINS, at)) == as_set(alone)


def test_dq_report_against_a_plain_count(bronze):
    """Every count of the report from collected rows, and zeros for an empty table."""
    found = {r.rule: tuple(r)[3:] for r in dq_report(bronze, "transaction_id").collect()}
    n = bronze.count()
    for r in SALES_RULES:
        marked = bronze.select(r.violated().alias("v"), F.col(r.column).isNull().alias("n")).collect()
        assert found[r.name] == (n, sum(m.v for m in marked), sum(m.n for m in marked))
    keys = [r[0] for r in bronze.select("transaction_id").collect()]
    assert found["duplicate_key"] == (n, n - len(set(keys)), keys.count(None))
    assert {tuple(r)[3:] for r in dq_report(bronze.limit(0), "transaction_id").collect()} == {(0, 0, 0)}
