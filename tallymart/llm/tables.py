"""Reading the corpus tables and writing intermediate ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymart.sources.scratch import scratch_path


def corpus(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared checkpoint folder and read from there.

    This ends the lineage: a lost executor repeats reads of these files, not the
    work before them. The planner then also knows the table's real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
