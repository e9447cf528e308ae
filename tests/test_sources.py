"""CSV and Parquet edges."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError

from tallymart import RAW_SCHEMA, assert_schema, read_layer, read_raw_csv, write_layer
from tallymart import write_raw_csv
from tallymart.schema import SchemaMismatch
from tallymart.sources.layers import assert_apart
from tallymart.sources.scratch import scratch_path
from tests import rows


def header_with(old: str, new: str) -> str:
    return rows.HEADER.replace(old, new)


@pytest.mark.parametrize(
    "header",
    [
        header_with("order_date,ship_date", "ship_date,order_date"),
        header_with("quantity", "qty"),
        header_with(",ingestion_date", ""),
        rows.HEADER + ",extra",
    ],
    ids=["reordered", "renamed", "missing", "extra"],
)
def test_a_wrong_header_fails_the_read(spark, tmp_path, header):
    path = rows.write_csv(tmp_path, header)
    with pytest.raises(Py4JJavaError, match="CSV header"):
        read_raw_csv(spark, path).collect()
    assert read_raw_csv(spark, path, check_header=False).count() == len(rows.BOUNDARY)


def test_every_file_of_a_folder_is_checked(spark, tmp_path):
    rows.write_csv(tmp_path)
    (tmp_path / "second.csv").write_text("a" + rows.HEADER + "\n" + rows.csv_line(rows.BOUNDARY[0]))
    with pytest.raises(Py4JJavaError, match="CSV header"):
        read_raw_csv(spark, str(tmp_path)).collect()


def test_short_long_and_empty_rows(spark, tmp_path):
    lines = ["t1,2024-01-10", rows.csv_line(rows.BOUNDARY[0]) + ",surplus", "," * 15]
    got = read_raw_csv(spark, rows.write_csv(tmp_path, rows=lines)).collect()
    assert len(got) == 3
    assert got[0].transaction_id == "t1" and got[0].ingestion_date is None
    assert got[1].transaction_id == "e01" and got[1].order_status == "Delivered"
    assert all(v is None for v in got[2])


def test_csv_round_trip_keeps_spaces_nulls_and_floats(spark, tmp_path):
    df = read_raw_csv(spark, rows.write_csv(tmp_path))
    out = str(tmp_path / "out")
    write_raw_csv(df, out)
    assert sorted(map(str, read_raw_csv(spark, out).collect())) == sorted(map(str, df.collect()))


def part_files(path) -> int:
    return len(list(path.glob("part-*.parquet")))


def test_layer_file_counts(spark, tmp_path):
    df = spark.range(0, 10_000, 1, 3)
    for files, by, expected in [(24, None, 24), (8, "id", 8), (None, None, 3)]:
        path = tmp_path / f"out-{files}"
        write_layer(df, str(path), files, by)
        assert part_files(path) == expected
        assert spark.read.parquet(str(path)).count() == 10_000


def test_reading_a_layer_of_another_schema_fails(spark, tmp_path):
    path = str(tmp_path / "layer")
    write_layer(spark.range(3), path)
    with pytest.raises(SchemaMismatch, match="transaction_id"):
        read_layer(spark, path, RAW_SCHEMA)


def test_schema_check_names_a_changed_type(spark):
    df = spark.createDataFrame([], RAW_SCHEMA)
    assert assert_schema(df, RAW_SCHEMA) is df
    with pytest.raises(SchemaMismatch, match="quantity"):
        assert_schema(df.withColumn("quantity", df.quantity.cast("bigint")), RAW_SCHEMA)


@pytest.mark.parametrize(
    "source, target",
    [
        ("/a/b", "/a/b"),
        ("/a/b", "/a/b/"),
        ("/a/b", "/a/x/../b"),
        ("/a/b", "file:/a/b"),
        ("file:///a/b", "/a/b/c"),
        ("/a/b/c", "/a/b"),
        ("s3a://bucket/a", "s3a://bucket/a/b"),
    ],
)
def test_output_over_input_is_refused(source, target):
    with pytest.raises(ValueError, match="overlaps"):
        assert_apart([source], [target])


def test_separate_outputs_are_accepted():
    assert_apart(["/a/b"], ["/a/bc", "/a/c", "s3a://a/b"])
    with pytest.raises(ValueError, match="overlaps"):
        assert_apart(["/a/b"], ["/a/c", "/a/c/d"])


def test_scratch_lies_under_the_checkpoint_folder(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or first.startswith(base)
