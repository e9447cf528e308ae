"""The staged jobs on disk, and their command line."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

import jobs
from tallymart import (
    Layout,
    clean,
    daily_mart,
    facts,
    read_layer,
    read_raw_csv,
    run_bronze,
    run_gold,
    run_pipeline,
    run_silver,
    sales_cube,
    synth_sales,
    with_total_amount,
    write_layer,
)
from tallymart.operators import rollups
from tallymart.plans import pipeline, sizing
from tallymart.schema import CATEGORY_SCHEMA, CITY_SCHEMA, DAILY_SCHEMA, RAW_SCHEMA
from tallymart.sources import csv_feed
from tests import rows


def marts_of(spark, layout):
    return {
        name: {tuple(r) for r in read_layer(spark, path, schema).collect()}
        for name, path, schema in [
            ("daily", layout.daily, DAILY_SCHEMA),
            ("category", layout.category, CATEGORY_SCHEMA),
            ("city", layout.city, CITY_SCHEMA),
        ]
    }


EXPECTED = {
    "daily": {(k, *v) for k, v in rows.DAILY.items()},
    "category": {(k, *v) for k, v in rows.CATEGORY.items()},
    "city": {(*k, *v) for k, v in rows.CITY.items()},
}


@pytest.mark.parametrize("files", [(None, None), (24, 8)], ids=["as-is", "24-and-8"])
def test_pipeline_counts_layers_and_marts(spark, tmp_path, files):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path))
    counts = run_pipeline(spark, layout, *files, order_by=rows.ORDER)
    assert counts == {"bronze": 14, "deduplicated": 13, "silver": 9, "unpriceable": 0}
    bronze = read_layer(spark, layout.bronze, RAW_SCHEMA)
    assert bronze.count() == 14
    assert read_layer(spark, layout.silver, RAW_SCHEMA).count() == 9
    assert marts_of(spark, layout) == EXPECTED
    if files[0]:
        assert len(list((tmp_path / "silver").glob("part-*.parquet"))) <= files[1]


def test_running_again_overwrites(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path))
    run_pipeline(spark, layout)
    run_pipeline(spark, layout, order_by=rows.ORDER)
    assert marts_of(spark, layout) == EXPECTED


def test_windows_line_ends_and_several_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i, part in enumerate([rows.BOUNDARY[:5], rows.BOUNDARY[5:]]):
        lines = [rows.HEADER, *map(rows.csv_line, part)]
        (raw / f"{i}.csv").write_bytes("".join(x + "\r\n" for x in lines).encode())
    layout = Layout.under(str(tmp_path), raw=str(raw))
    run_pipeline(spark, layout, order_by=rows.ORDER)
    assert marts_of(spark, layout) == EXPECTED


def test_a_feed_without_rows_gives_empty_marts(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path, rows=[]))
    counts = run_pipeline(spark, layout)
    assert counts == {"bronze": 0, "deduplicated": 0, "silver": 0, "unpriceable": 0}
    assert marts_of(spark, layout) == {"daily": set(), "category": set(), "city": set()}


def test_an_error_stops_the_pipeline(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path, "wrong" + rows.HEADER))
    with pytest.raises(Py4JJavaError, match="CSV header"):
        run_pipeline(spark, layout)
    assert not (tmp_path / "silver").exists()


def test_a_stage_refuses_to_overwrite_its_input(spark, tmp_path):
    path = str(tmp_path / "layer")
    for stage in (run_bronze, run_silver):
        with pytest.raises(ValueError, match="overlaps"):
            stage(spark, path, path)
    with pytest.raises(ValueError, match="overlaps"):
        run_gold(spark, path, path + "/d", str(tmp_path / "c"), str(tmp_path / "t"), "x")


def test_silver_order_by_picks_the_survivor(spark, tmp_path):
    raw = rows.write_csv(tmp_path)
    run_bronze(spark, raw, str(tmp_path / "b"))
    bronze = read_layer(spark, str(tmp_path / "b"))
    flipped = bronze.withColumn("newest_first", -F.col("discount_pct"))
    got = clean(flipped, ["newest_first", "order_date"]).where("transaction_id is null")
    assert [r.discount_pct for r in got.collect()] == [None]
    got = clean(bronze.withColumn("priced", F.col("discount_pct").isNull()), ["priced"])
    assert [r.discount_pct for r in got.where("transaction_id is null").collect()] == [0.0]


def test_float_mode_through_the_cube_is_close_to_exact(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path))
    run_pipeline(spark, layout, mode="float", order_by=rows.ORDER)
    got = {r[0]: r[1] for r in read_layer(spark, layout.daily, DAILY_SCHEMA).collect()}
    assert got[rows.D10] == pytest.approx(10.0)


def test_cube_marts_equal_direct_marts(spark, tmp_path):
    raw = rows.write_csv(tmp_path)
    direct = with_total_amount(clean(read_raw_csv(spark, raw), rows.ORDER))
    got = {tuple(r) for r in daily_mart(facts(direct, "order_date")).collect()}
    assert got == EXPECTED["daily"]


def test_command_line_stages(spark, tmp_path, capsys):
    raw = rows.write_csv(tmp_path)
    layout = Layout.under(str(tmp_path), raw=raw)
    jobs.main(["bronze", "--input", raw, "--output", layout.bronze, "--files", "3"])
    jobs.main(
        ["silver", "--input", layout.bronze, "--output", layout.silver]
        + ["--order-by", *rows.ORDER]
    )
    jobs.main(
        ["gold", "--input", layout.silver, "--daily-output", layout.daily]
        + ["--category-output", layout.category, "--city-output", layout.city]
        + ["--cube-output", layout.cube]
    )
    printed = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert printed[0] == {"job": "bronze", "bronze": 14}
    assert printed[1] == {"job": "silver", "bronze": 14, "deduplicated": 13, "silver": 9}
    assert printed[2] == {"job": "gold", "unpriceable": 0}
    assert marts_of(spark, layout) == EXPECTED


def test_command_line_reports_and_quality(spark, tmp_path, capsys):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path))
    run_pipeline(spark, layout, order_by=rows.ORDER)
    jobs.main(["reports", "--input", layout.cube, "--output", str(tmp_path / "reports")])
    names = json.loads(capsys.readouterr().out.splitlines()[-1])["reports"]
    assert len(names) == 12
    bubble = read_layer(spark, str(tmp_path / "reports" / "city_revenue_bubble"))
    assert {tuple(r) for r in bubble.collect()} == {(*k, v[0]) for k, v in rows.CITY.items()}
    jobs.main(["dq-report", "--input", layout.bronze, "--output", str(tmp_path / "dq")])
    assert read_layer(spark, str(tmp_path / "dq")).count() == 8


def test_a_renamed_header_loads_by_position(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path, "wrong" + rows.HEADER))
    run_pipeline(spark, layout, order_by=rows.ORDER, check_header=False)
    assert marts_of(spark, layout) == EXPECTED


def test_silver_with_files_has_one_exchange(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(pipeline, "write_layer", lambda df, path: (written.append(df), write_layer(df, path)))
    bronze = str(tmp_path / "b")
    write_layer(synth_sales(spark, 20_000, dt.date(2026, 1, 1), partitions=4), bronze)
    run_silver(spark, bronze, str(tmp_path / "s"), files=5)
    assert written[0]._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("Exchange") == 1
    assert len(list((tmp_path / "s").glob("part-*.parquet"))) == 5


def test_a_nan_price_is_counted_and_shows(spark, tmp_path):
    layout = Layout.under(str(tmp_path), raw=rows.write_csv(tmp_path))
    run_pipeline(spark, layout, order_by=rows.ORDER)
    silver = read_layer(spark, layout.silver).withColumn("unit_price", F.lit(float("nan")).cast("float"))
    silver = silver.withColumn("discount_pct", F.lit(0).cast("float"))
    for mode in ("exact", "float"):
        cube = sales_cube(with_total_amount(silver, mode))
        assert cube.agg(F.sum("unpriceable")).first()[0] == silver.count()
        kpi = rollups.kpi_daily(cube).first()
        assert math.isnan(kpi.sum_of_daily_avg_order_value) and math.isnan(kpi.mean_daily_revenue)
        assert math.isnan(rollups.kpi_states(cube).first().avg_revenue_per_state)


def test_command_line_generate_and_pipeline(spark, tmp_path, capsys):
    raw = str(tmp_path / "raw")
    jobs.main(["generate", "--output", raw, "--rows", "2000"])
    jobs.main(["pipeline", "--root", str(tmp_path), "--raw", raw])
    counts = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert counts["bronze"] == 2000
    assert 0 < counts["silver"] < counts["deduplicated"] < 2000


def test_files_come_from_splits_without_a_shuffle(spark, tmp_path, monkeypatch):
    """As many splits as files: bronze moves no row, in files that hold all rows; raw text is compressed."""
    written = []
    monkeypatch.setattr(csv_feed, "ROWS_A_FILE", 500, raising=False)
    monkeypatch.setattr(pipeline, "write_layer", lambda df, path: (written.append(df), write_layer(df, path)))
    raw, bronze = str(tmp_path / "raw"), str(tmp_path / "b")
    sales = synth_sales(spark, 20_000, dt.date(2026, 1, 1), partitions=4)
    csv_feed.write_raw_csv(sales, raw)
    assert len(list((tmp_path / "raw").glob("*.csv.gz"))) == 40
    monkeypatch.setattr(sizing, "MB", 1)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert pipeline.run_bronze(spark, raw, bronze, files=10) == {"bronze": 20_000}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "b").glob("part-*.parquet"))) == 10
    assert sorted(map(str, read_layer(spark, bronze).collect())) == sorted(map(str, sales.collect()))


def test_silver_files_take_several_partitions_each(spark, tmp_path, monkeypatch):
    bronze = str(tmp_path / "b")
    write_layer(synth_sales(spark, 20_000, dt.date(2026, 1, 1), partitions=4), bronze)
    expected = sorted(map(str, clean(read_layer(spark, bronze)).collect()))
    monkeypatch.setattr(sizing, "partition_bytes", lambda shuffled: max(shuffled // 12, 1))
    assert int(sizing.shuffle_sized(spark, bronze, 5).conf.get(sizing.SHUFFLE)) == 15
    run_silver(spark, bronze, str(tmp_path / "s"), files=5)
    assert len(list((tmp_path / "s").glob("part-*.parquet"))) == 5
    assert sorted(map(str, read_layer(spark, str(tmp_path / "s")).collect())) == expected
