"""Physical plans: what must and must not be in them at any size."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from checks import star_queries
from tallymart import clean, daily_mart, dq_report, facts, read_layer, sales_cube, synth_sales
from tallymart import with_total_amount, write_layer
from tallymart.functions import global_windows
from tallymart.functions.global_windows import with_rank_desc
from tallymart.operators.marts import roll_ups
from tallymart.plans.pipeline import MART_GRAINS
from tallymart.plans.silver import layer_counts
from tallymart.sources.scratch import written
from tests.conftest import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")
WRITES_WHEN_BUILT = {"bronze_ingest", "pipeline_end_to_end"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "no-broadcast"])
def joins(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(set(star_queries.registered()) - WRITES_WHEN_BUILT))
def test_no_query_has_a_cross_join_python_or_a_whole_table_in_one_task(joins, name):
    plan = plan_of(registry.queries()[name](joins, FOLDER))
    for bad in ("Cartesian", "NestedLoop", "EvalPython", "InPandas", "MapInArrow", "RowDataSource"):
        assert bad not in plan, bad
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only partial aggregates and bounded summaries meet in one task
            assert re.search(r"partial_|HashAggregate\(keys=\[_(band|slice)", lines[i + 1])


def test_order_share_deduplicates_once(spark):
    df = registry.queries()["category_order_share"](spark, str(TESTDATA / "sf0.01"))
    df.collect()
    plan = plan_of(df)
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("row_number(), 1, Final") == 1


def test_rank_deduplicates_once(spark, monkeypatch):
    """The ranked table is written once; what follows reads it."""
    plans = []

    def seen(df, name):
        plans.append(plan_of(df))
        return written(df, name)

    monkeypatch.setattr(global_windows, "written", seen)
    df = registry.queries()["category_revenue_rank"](spark, str(TESTDATA / "sf0.01"))
    assert df.count() > 0
    assert [p.count("row_number(), 1, Final") for p in [*plans, plan_of(df)]] == [1, 0, 0]


def test_close_values_are_ranked_in_all_tasks(spark, monkeypatch):
    """100,000 distinct values within 0.1 %, a third of them in one, nulls and equal ones beside them."""
    n, tables = 100_000, {}

    def seen(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(global_windows, "written", seen)
    own = F.lit(1000.0) + F.col("id") / n
    value = F.when(F.col("id") % 10 == 9, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(1000.5)).otherwise(own)
    df = spark.range(0, n, 1, 8).select("id", value.alias("v"))
    values = [r.v for r in df.collect()]
    known = sorted((v for v in values if v is not None), reverse=True)
    first = {v: at for at, v in reversed(list(enumerate(known, 1)))} | {None: len(known) + 1}
    found = with_rank_desc(df, "v", "r").select("id", "r").collect()
    assert len(found) == n and all(first[values[r.id]] == r.r for r in found)
    bands = F.shiftright("_place", 33)
    sizes = [r["count"] for r in tables["ranges"].groupBy(bands).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_layer_counts_use_hash_aggregates(spark, layers):
    plan = plan_of(layer_counts(read_layer(spark, layers[0])))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2
    several = plan_of(layer_counts(read_layer(spark, layers[0]), ["order_date", "ship_date"]))
    assert "SortAggregate" not in several


@pytest.mark.parametrize("order_by", [None, ["order_date", "ship_date"], ["order_date", "city", "unit_price"]])
def test_layer_counts_are_one_scan_without_windows(spark, layers, order_by):
    plan = plan_of(layer_counts(read_layer(spark, layers[0]), order_by))
    assert plan.count("FileScan") == 1 and "Window" not in plan
    # partial before the one shuffle of rows, then the sums of all tasks
    assert plan.count("Exchange") == 2 and "partial_" in plan[plan.index("Exchange hashpartitioning") :]


def test_dq_report_is_one_scan_with_a_partial_aggregate(spark, layers):
    plan = plan_of(dq_report(read_layer(spark, layers[0]), "transaction_id"))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "SortAggregate" not in plan
    assert "partial_count" in plan[plan.index("Exchange hashpartitioning") :]


def test_dq_report_computes_a_derived_input_once(spark):
    """The feed is joins; each table is read once for all of the report."""
    df = registry.queries()["dq_report"](spark, FOLDER)
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan_of(df))
    once = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan_of(star_queries._bronze(spark, FOLDER)))
    assert scans and sorted(scans) == sorted(once)


def test_all_marts_are_one_scan_of_the_cube(spark, layers, tmp_path):
    write_layer(sales_cube(with_total_amount(read_layer(spark, layers[1]))), str(tmp_path / "cube"))
    plan = plan_of(roll_ups(read_layer(spark, str(tmp_path / "cube")), MART_GRAINS))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan[plan.index("Exchange") :]


def test_half_null_and_half_equal_values_are_ranked_without_a_hot_task(spark):
    n = 40_000
    value = F.when(F.col("id") % 2 == 0, F.lit(10.0))
    df = spark.range(0, n, 1, 8).select("id", value.alias("v"))
    ranked = with_rank_desc(df, "v", "r")
    ranked.collect()
    assert {tuple(r) for r in ranked.select("v", "r").distinct().collect()} == {(10.0, 1), (None, n // 2 + 1)}
    plan = plan_of(ranked)
    final = plan[: plan.index("== Initial Plan ==")]
    assert all("Window" not in line or "_value" in line or "_band" in line for line in final.splitlines())
    assert shuffled_records(ranked) <= 2 * 8 * 4


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    bronze = str(root / "bronze")
    silver = str(root / "silver")
    write_layer(synth_sales(spark, 20_000, dt.date(2026, 1, 1), partitions=4), bronze)
    write_layer(clean(read_layer(spark, bronze)), silver)
    return bronze, silver


def test_deduplication_keeps_one_row_per_key_and_task_before_its_only_shuffle(spark, layers):
    plan = plan_of(clean(read_layer(spark, layers[0])))
    assert plan.count("Exchange") == 1
    before_shuffle = plan[plan.index("Exchange") :]
    assert re.search(r"WindowGroupLimit .*row_number\(\), 1, Partial", before_shuffle)


def test_marts_read_only_their_columns(spark, layers):
    rows = with_total_amount(read_layer(spark, layers[1]))
    plan = plan_of(daily_mart(facts(rows, "order_date")))
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert [c.split(":")[0] for c in read.split(",")] == [
        "transaction_id",
        "order_date",
        "quantity",
        "unit_price",
        "discount_pct",
    ]
    assert "partial_sum" in plan[plan.index("Exchange") :]


def test_cube_is_one_scan_and_one_shuffle(spark, layers):
    plan = plan_of(sales_cube(with_total_amount(read_layer(spark, layers[1]))))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of the rows share one id, a third have none: few of them are moved."""
    n, tasks = 60_000, 6
    own = F.col("id").cast("string")
    ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, own)
    sales = synth_sales(spark, n, dt.date(2026, 1, 1), partitions=tasks)
    keyed = sales.withColumn("id", F.monotonically_increasing_id())
    skewed = keyed.withColumn("transaction_id", ids).drop("id")
    cleaned = clean(skewed)
    cleaned.collect()
    distinct = skewed.select("transaction_id").distinct().count()
    moved = shuffled_records(cleaned)
    assert moved <= distinct + 2 * tasks
    assert cleaned.where("transaction_id is null").count() <= 1
    assert cleaned.where("transaction_id = 'hot'").count() <= 1


def shuffled_records(df) -> int:
    """Records its shuffles wrote, from the metrics of the plan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan

    def walk(node) -> int:
        total = 0
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        return total + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(plan)
