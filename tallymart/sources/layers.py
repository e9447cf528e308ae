"""Parquet layers, handed from stage to stage by path."""

from __future__ import annotations

import uuid
from posixpath import basename, normpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymart.schema import assert_schema


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Scan a Parquet layer; with ``schema``, fail at once if its files differ from it."""
    df = spark.read.parquet(path)
    return df if schema is None else assert_schema(df, schema)


def write_layer(
    df: DataFrame, path: str, files: int | None = None, by: str | None = None
) -> None:
    """Replace a Parquet layer.

    The rows are written beside the layer, under a hidden name, and take its place once
    all are there. A write that fails leaves the layer as it was. A driver that dies between
    the two renames leaves the old rows as ``.<name>.old-…`` beside the place. Where a
    store copies on rename, the swap takes that long.

    Without ``files`` the data is written with the partitioning it has: no
    shuffle. With ``files`` it is spread evenly over that many: by hash of
    ``by``, which should be unique, else round robin.
    """
    if files is not None:
        df = df.repartition(files, by) if by else df.repartition(files)
    place = path.rstrip("/")
    name = basename(place)
    beside = place[: len(place) - len(name)]
    new, old = (f"{beside}.{name}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    try:
        df.write.parquet(new)
        _swap(df.sparkSession, new, place, old)
    except BaseException:
        _Store(df.sparkSession, new).delete(new)
        raise


def _swap(spark: SparkSession, new: str, place: str, old: str) -> None:
    """Put ``new`` into ``place``; what was there comes back if that fails."""
    store = _Store(spark, place)
    had = store.exists(place)
    if had:
        store.rename(place, old)
    try:
        store.rename(new, place)
    except BaseException:
        if had:
            store.rename(old, place)
        raise
    if had:
        store.delete(old)


class _Store:
    """The file system of a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.path = context._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(path).getFileSystem(context._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def rename(self, path: str, to: str) -> None:
        if not self.system.rename(self.path(path), self.path(to)):
            raise OSError(f"cannot rename {path!r} to {to!r}")

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def assert_apart(inputs: list[str], outputs: list[str]) -> None:
    """Refuse outputs that lie on, in or around an input or each other.

    Overwriting a path that is still being read loses the data.
    """
    for i, out in enumerate(outputs):
        for other in inputs + outputs[:i]:
            a, b = _normal(out), _normal(other)
            if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
                raise ValueError(f"output {out!r} overlaps {other!r}")


def _normal(path: str) -> str:
    """One spelling per path; a bare path and its ``file:`` form are the same."""
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        scheme, rest = "file", path
    return scheme + ":" + normpath("/" + rest.lstrip("/") if rest.startswith("/") else rest)
