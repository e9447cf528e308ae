"""Deterministic sharded WARC files.

Records are range-partitioned and sorted by key; each task writes its range as one
series of files, each record a gzip member of its own, and begins a new file once
the compressed size reaches the limit. Headers, record ids and digests follow from
the rows and the parameters alone, so a task that runs again writes the same bytes.
Files appear under their names when complete; the manifest comes last.

A payload of at least ``least`` bytes that several records share is stored with
the record of the largest key; the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm.shared_files import Folder
from tallymart.llm.tables import stored

MANIFEST = "manifest.json"
MANIFEST_SCHEMA = "name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = (
    "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
#: Fixed value: the profile that the format names for repeated payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("5b7f4c1e-0c5a-5d3c-9d53-2a8f6f1f7c10")
_READ_AT_ONCE = 1 << 20
_END = b"\r\n\r\n"


def write_warc(
    df: DataFrame,
    folder: str,
    date: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    file_bytes: int = 256 << 20,
    shards: int | None = None,
) -> str:
    """Write one record for each row into a new folder and return the folder.

    ``date`` is the WARC-Date of all records. A null payload counts as empty; a null
    url becomes a URN of the key. Records are sorted by key, null keys first, then
    url and payload. Rows that share key and payload are records of their own, alike
    in type; a row without key refers to the group's largest key, and stands for the
    group only if no row has one. An empty table gives an empty manifest.
    Without ``shards`` the rows are dealt over as many tasks as the session has
    shuffle partitions.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumn("sum", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.where("sum is not null").groupBy("sum").agg(F.max("key").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select("sum", "first"), "payloads")
    if shards is None:
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    Folder(folder).made()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series = _Series(Folder(folder), TaskContext.get().partitionId(), date, file_bytes)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from series.add(*row)
        yield from series.close()

    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    written = (
        rows.join(groups, "sum", "left")
        .select("key", "url", "payload", refers)
        .repartitionByRange(shards, "key")
        .sortWithinPartitions("key", "url", "payload")
        .mapInArrow(write, MANIFEST_SCHEMA)
    )
    files = sorted(written.collect(), key=lambda r: r["name"])
    with Folder(folder).new(MANIFEST) as stream:
        for file in files:
            stream.write(json.dumps(file.asDict(), sort_keys=True).encode() + b"\n")
    return folder


class _Series:
    """The files of one task."""

    def __init__(self, folder: Folder, shard: int, date: str, file_bytes: int):
        self.folder, self.shard, self.date, self.limit = folder, shard, date, file_bytes
        self.count, self.context = 0, None

    def add(self, key: int | None, url: str | None, payload: str, refers_to: int | None):
        if self.context is None:
            self.name = f"part-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.count += 1
            self.context = self.folder.new(self.name)
            self.stream = self.context.__enter__()
            self.records, self.bytes, self.digest = 0, 0, hashlib.sha256()
            self._put(_info(self.name, self.date))
        self._put(_record(key, url, payload.encode("utf-8", "surrogatepass"), refers_to, self.date))
        self.records += 1
        if self.bytes >= self.limit:
            yield from self.close()

    def _put(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.context is not None:
            self.context.__exit__(None, None, None)
            self.context = None
            yield pa.RecordBatch.from_pydict(
                {"name": [self.name], "records": [self.records], "bytes": [self.bytes], "sha256": [self.digest.hexdigest()]}
            )


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(kind: str, name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{name}')}>"


def _joined(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", _id("info", name)),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    return _joined(headers, block)


def _record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    target = url if url else f"urn:page:{'' if key is None else key}"
    target = re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02X}" if c[0] != "%" else "%", target)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _id("page", key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    if key is not None:
        headers.append(("X-Key", key))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _id("page", refers_to)),
            ("X-Refers-To-Key", refers_to),
        ]
    return _joined(headers, block)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of a folder: ``key, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Size and bare hex SHA-1 are of the full payload, also for revisits, whose
    ``payload`` is null. Digests of blocks and payloads are computed again; a record
    that does not match its headers ends the job. Without ``payloads`` that column
    is null.
    """
    files = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(folder, MANIFEST))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Folder(folder)
        schema = pa.schema(
            [
                ("key", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("payload", pa.binary()),
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for headers, block in records(store, name):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    rows.append(_page(headers, block, payloads))
                    size += len(block) if payloads else 200
                    if size >= _READ_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartition(tasks, "name").mapInArrow(read, RECORD_SCHEMA)


def records(folder: Folder, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one gzip member at a time."""
    with folder.open(name) as stream:
        rest = b""
        while True:
            member, unpack = [], zlib.decompressobj(31)
            while not unpack.eof:
                chunk = rest or stream.read(_READ_AT_ONCE)
                if not chunk:
                    if member:
                        raise ValueError(f"{name} ends within a record")
                    return
                member.append(unpack.decompress(chunk))
                rest = unpack.unused_data
            head, _, tail = b"".join(member).partition(_END)
            lines = head.decode().split("\r\n")[1:]
            headers = dict(line.split(": ", 1) for line in lines)
            block = tail[: int(headers["Content-Length"])]
            if tail[len(block) :] != _END or headers["WARC-Block-Digest"] != _sha1(block):
                raise ValueError(f"{name}: a record does not match its headers")
            yield headers, block


def _page(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    http, _, payload = block.partition(_END)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _sha1(payload) != headers["WARC-Payload-Digest"]):
        raise ValueError("a payload does not match its headers")
    return {
        "key": int(headers["X-Key"]) if "X-Key" in headers else None,
        "url": headers["WARC-Target-URI"],
        "record_type": headers["WARC-Type"],
        "refers_to": int(headers["X-Refers-To-Key"]) if revisit else None,
        "payload_bytes": size,
        "payload_digest": base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload": payload if payloads and not revisit else None,
    }
