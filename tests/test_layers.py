"""Replacing layers: all rows or the old ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymart.sources import layers
from tallymart.sources.layers import read_layer, write_layer


def names(path) -> list[str]:
    return sorted(p.name for p in path.iterdir())


def values(spark, path) -> list[int]:
    return sorted(r.id for r in read_layer(spark, str(path)).collect())


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}"])
def test_a_layer_is_replaced_whole(spark, tmp_path, form):
    path = form.format(tmp_path / "layer")
    write_layer(spark.range(5), path)
    write_layer(spark.range(3), path, files=2)
    assert values(spark, tmp_path / "layer") == [0, 1, 2]
    assert names(tmp_path) == ["layer"]


def test_a_failed_write_leaves_the_old_layer(spark, tmp_path):
    path = tmp_path / "layer"
    write_layer(spark.range(5), str(path))
    # some tasks end before another fails
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error("no")).otherwise("x"), "id")
    with pytest.raises(Exception, match="no"):
        write_layer(broken.toDF("x", "id"), str(path))
    assert values(spark, path) == list(range(5))
    assert names(tmp_path) == ["layer"]


def test_a_failed_swap_leaves_the_old_layer(spark, tmp_path, monkeypatch):
    path = tmp_path / "layer"
    write_layer(spark.range(5), str(path))
    rename = layers._Store.rename

    def refuse(store, source, to):
        if ".new-" in source:
            raise OSError("refused")
        rename(store, source, to)

    monkeypatch.setattr(layers._Store, "rename", refuse)
    with pytest.raises(OSError, match="refused"):
        write_layer(spark.range(3), str(path))
    assert values(spark, path) == list(range(5))
    assert names(tmp_path) == ["layer"]


def test_a_layer_may_be_made_from_itself(spark, tmp_path):
    path = tmp_path / "layer"
    write_layer(spark.range(5), str(path))
    write_layer(read_layer(spark, str(path)).where("id > 2"), str(path))
    assert values(spark, path) == [3, 4]


def test_a_relative_path_stays_relative(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(layers, "_swap", lambda spark, new, place, old: written.extend([new, place, old]))
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda writer, path: written.append(path))
    write_layer(spark.range(1), "layer")
    assert len(written) == 4 and not any("/" in path for path in written)
