"""The raw edge: header-bearing CSV under an enforced schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymart.schema import RAW_SCHEMA


#: A compressed file is read by one task; of these rows that is about 30 MB of text.
ROWS_A_FILE = 250_000


def read_raw_csv(
    spark: SparkSession, path: str | list[str], check_header: bool = True
) -> DataFrame:
    """Scan raw sales CSV: a file, a folder or several of either.

    Every row is kept. A cell that does not parse as its declared type is
    null; a short row ends in nulls. Columns go by position, so each task that
    opens the start of a file compares its header with the schema and fails
    the job on a renamed, missing or reordered column; ``check_header=False``
    loads such files by position instead.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .csv(path)
    )


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write raw sales as compressed CSV parts with a header each; nulls are empty fields.

    Outer spaces are part of a value, so the writer's default trimming is off.
    """
    (
        df.select(*RAW_SCHEMA.fieldNames())
        .write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ROWS_A_FILE)
        .csv(path)
    )
