"""Token ids in flat binary files.

A folder holds, for each shard, ``part-N.bin`` (ids as unsigned 16- or 32-bit
integers), ``part-N.idx`` (64-bit offsets, one more than documents) and
``part-N.keys`` (64-bit document keys; null keys come first and are counted in
the manifest). ``manifest.json`` has a line for each shard with its base: the
number of ids before it, the prefix sum of the shards' lengths. It is written
last, so a folder without it is not complete.

One shuffle: texts are range-partitioned by key and sorted within the partition;
each task then encodes its texts as they stream by and writes its shard.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm.bpe import vocabulary
from tallymart.llm.library_ids import LibraryIds
from tallymart.llm.shared_files import Folder

MANIFEST = "manifest.json"
MANIFEST_SCHEMA = "shard int, base long, tokens long, documents long, null_keys long, kind string"


def write_token_files(
    df: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> str:
    """Encode all texts with the library's vocabulary at ``path`` into a new folder; returns the folder.

    ``end_id`` follows each document. Documents are in ascending key order, null
    keys first, equal keys by text. A null text counts as empty and has the end id
    only. Repeated rows are written as often as they come; an empty table gives a
    manifest without shards. Without ``shards``, there are as many as the session has
    shuffle partitions.
    """
    spark = df.sparkSession
    if shards is None:
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = vocabulary(spark, path)
    Folder(folder).made()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryIds.load(content.value)
        ids_kind = encoder.kind_with(end_id)
        end = np.array([end_id], ids_kind).tobytes()
        out, shard = Folder(folder), TaskContext.get().partitionId()
        offsets, keys, null_keys, at = array("Q", [0]), array("q"), 0, 0
        name = f"part-{shard:06d}"
        with out.new(f"{name}.bin") as stream:
            for batch in batches:
                for value, document in zip(batch.column(0).to_pylist(), encoder.packed(batch.column(1), ids_kind)):
                    stream.write(document)
                    stream.write(end)
                    at += len(document) // ids_kind.itemsize + 1
                    offsets.append(at)
                    null_keys += value is None
                    keys.append(value or 0)
        with out.new(f"{name}.idx") as stream:
            stream.write(np.frombuffer(offsets, np.uint64).astype("<u8").tobytes())
        with out.new(f"{name}.keys") as stream:
            stream.write(np.array(keys, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "tokens": [at],
                "documents": [len(keys)],
                "null_keys": [null_keys],
                "kind": [ids_kind.str],
            }
        )

    written = (
        df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        .repartitionByRange(shards, "key")
        .sortWithinPartitions("key", "text")
        .mapInArrow(write, "shard int, tokens long, documents long, null_keys long, kind string")
    )
    found = sorted((r.asDict() for r in written.collect()), key=lambda r: r["shard"])
    bases = accumulate((r["tokens"] for r in found), initial=0)
    with Folder(folder).new(MANIFEST) as stream:
        for row, base in zip(found, bases):
            if row["documents"]:
                stream.write(json.dumps(row | {"base": base}).encode() + b"\n")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``key, start, n_tokens, ids`` of each document of a folder, ids as little-endian unsigned 32-bit."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    shards = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(folder, MANIFEST))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                name = f"part-{shard['shard']:06d}"
                ids = files.array(f"{name}.bin", shard["kind"])
                offsets = files.array(f"{name}.idx", "<u8").astype(np.int64)
                keys = files.array(f"{name}.keys", "<i8")
                yield from _documents(shard, ids, offsets, keys, schema.names)

    return shards.repartition(tasks, "shard").mapInArrow(read, schema)


def _documents(shard: dict, ids: np.ndarray, offsets: np.ndarray, keys: np.ndarray, names: list[str]):
    most = 1 << 21
    first, n = 0, len(keys)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        part = np.asarray(ids[offsets[first] : offsets[last]]).astype("<u4")
        cuts = offsets[first : last + 1]
        documents = pa.Array.from_buffers(
            pa.binary(),
            last - first,
            [None, pa.py_buffer(((cuts - cuts[0]) * 4).astype(np.int32)), pa.py_buffer(part)],
        )
        null = np.arange(first, last) < shard["null_keys"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(keys[first:last]), pa.int64(), mask=null),
                pa.array(cuts[:-1] + shard["base"], pa.int64()),
                pa.array(np.diff(cuts), pa.int64()),
                documents,
            ],
            names=names,
        )
        first = last
