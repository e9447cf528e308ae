"""Where intermediate tables go: a folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
_OWNED: set[str] = set()
_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table below the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; a session that sets none may
    only be a local one, which gets a folder of its own, since other machines could
    not read it. All paths of an application lie below one folder, which is its own
    and is deleted when its driver ends.
    """
    base = spark.conf.get(CHECKPOINTS, None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINTS} to a folder all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="tallymart-")
        base = _LOCAL[application]
    own = f"{base.rstrip('/')}/tallymart-{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        _OWNED.add(own)
        atexit.register(_delete, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a fresh intermediate table and read from there, which ends their lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through its own file system, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
