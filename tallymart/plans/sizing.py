"""Partition sizes that follow the input.

Adaptive execution merges small shuffle partitions but never splits the plain
ones, so a fixed partition count that suits a test would give partitions of
hundreds of gigabytes at full size.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 2**20
SCAN = "spark.sql.files.maxPartitionBytes"
SHUFFLE = "spark.sql.shuffle.partitions"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"

# Measured on the sales feed: a byte of compressed Parquet becomes two to four
# bytes of shuffled rows.
SHUFFLED_PER_STORED = 4

# Shuffled bytes per task. Below the lower bound tasks are not worth starting. The
# upper one is reached at 500 TB of stored rows; sorts and windows of that size spill.
MIN_PARTITION_BYTES = 128 * MB
MAX_PARTITION_BYTES = 8192 * MB
MIN_BLOCK_BYTES = 32 * 2**10

# Text bytes per task where splits are written as they are read: files of a
# quarter of that, as few tasks as a scheduler likes, all cores busy before.
MIN_SPLIT_BYTES = 128 * MB
MAX_SPLIT_BYTES = 512 * MB
MANY_TASKS = 10_000

#: So many for each file asked for, so that files come out even.
SPLITS_A_FILE = 4

ANY_SIZE = 2**60


def dataset_bytes(spark: SparkSession, path: str) -> int:
    """Stored size of a file or folder, from the file listing; no file is opened.

    However many files there are, a task per core adds up their lengths.
    """
    files = (
        _session(spark, {SCAN: ANY_SIZE})
        .read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.agg(F.sum("length")).first()[0] or 0


def partition_bytes(shuffled: int) -> int:
    """Bytes per task on either side of a shuffle of that many bytes.

    A shuffle between equally sized partitions moves blocks of
    ``size**2 / shuffled``. The size grows with the data so that blocks stay
    worth a fetch.
    """
    size = int(sqrt(shuffled * MIN_BLOCK_BYTES))
    return min(max(size, MIN_PARTITION_BYTES), MAX_PARTITION_BYTES)


def split_bytes(total: int) -> int:
    """Bytes per task of a job that only reads and writes."""
    return min(max(total // MANY_TASKS, MIN_SPLIT_BYTES), MAX_SPLIT_BYTES)


def scan_sized(spark: SparkSession, path: str, files: int | None = None) -> SparkSession:
    """A session for a job that writes ``path`` as it is read, with splits of a fitting size; for ``files``, several each."""
    total = dataset_bytes(spark, path)
    size = split_bytes(total)
    if files is not None:
        size = min(size, max(total // (SPLITS_A_FILE * files), MB))
    return _session(spark, {SCAN: size})


def into_files(df: DataFrame, files: int) -> DataFrame:
    """The rows in ``files`` partitions; without a shuffle if there are as many already and the cores all get one."""
    if files >= df.sparkSession.sparkContext.defaultParallelism and df.rdd.getNumPartitions() >= files:
        return df.coalesce(files)
    return df.repartition(files)


def shuffle_sized(spark: SparkSession, path: str, files: int | None = None) -> SparkSession:
    """A session for a job that shuffles the Parquet rows of ``path``, with partitions of a fitting size.

    Never fewer shuffle partitions than the caller's session has; with ``files``, a multiple of
    them that adaptive execution leaves alone, so that each file can take as many partitions.
    """
    shuffled = dataset_bytes(spark, path) * SHUFFLED_PER_STORED
    size = partition_bytes(shuffled)
    scan = {SCAN: size // SHUFFLED_PER_STORED}
    if files is not None:
        return _session(spark, scan | {SHUFFLE: files * max(ceil(shuffled / size / files), 1), COALESCE: "false"})
    partitions = max(ceil(shuffled / size), int(spark.conf.get(SHUFFLE)))
    return _session(spark, scan | {SHUFFLE: partitions})


def _session(spark: SparkSession, settings: dict[str, int | str]) -> SparkSession:
    """A session of the same application with the caller's settings but for these.

    The caller's session is left alone, so stages that run at once do not meet.
    """
    own = spark.newSession()
    for name, value in {**spark.conf.getAll, **settings}.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own
