"""Near-duplicates by MinHash.

1. Each text becomes its set of word shingles; of the set, a MinHash signature cut
   into bands, and an odd sketch (the parity of the shingles on each of 2,048 places).
2. Texts with the same set are one class, told apart by nothing. A number of its own
   stands for it from here on, since one key may have several texts; one row of its
   smallest key stands for the class, however often that row is repeated.
3. Classes with an equal band share a bucket; rows of buckets with more than one class
   are stored once. Each class is paired with the smallest of its bucket only. Pairs are
   verified by signature and sketch, then by their full sets, of texts that a Bloom
   filter of bounded size lets through to the join.
4. The links make components (large-star, small-star). A bucket whose classes are all
   in one component needs nothing more, and these are the large ones.
5. In the other buckets every two classes of different components are compared, by
   signature and sketch, in blocks of a thousand within a task. Only pairs that pass
   are sent, and verified by their full sets. No link between classes that share
   a band is lost, and no pairs of a group are written out.

The sketch never loses a link: the places where two sketches differ are at most
as many as the shingles in which two sets differ. At a similarity of 0.8 two sets
share one of 44 bands of 5 minima with a probability of 1 - 3e-8. The signature
must agree in 67 % of 220 places, five standard deviations below 80 %.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm import bloom
from tallymart.llm.components import components
from tallymart.llm.minhash_signatures import MinHash
from tallymart.llm.tables import stored
from tallymart.llm.words import WordHashes, shingles
from tallymart.sources.scratch import scratch_path

BANDS, ROWS, SEED = 44, 5, 20_240_131
SKETCH_BITS = 2048
BLOCK = 1024
_TEXTS_AT_ONCE = 256
_POPULATION = np.array([bin(b).count("1") for b in range(256)], np.uint16)

FEATURES = "key long, print long, n_shingles long, set_id binary, bands array<long>, signature binary, sketch binary"


def features(texts: DataFrame, width: int) -> DataFrame:
    """``key, print, n_shingles, set_id, bands, signature, sketch`` of rows ``key, text, print``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(BANDS, ROWS, SEED)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                rows = [_row(shingles(hashes.of(t), width), minhash) for t in part.column(1).to_pylist()]
                n, ids, bands, signatures, sketches = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(signatures, pa.binary()),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["key", "print", "n_shingles", "set_id", "bands", "signature", "sketch"],
                )

    return texts.mapInArrow(extract, FEATURES)


def _row(found: np.ndarray, minhash: MinHash) -> tuple:
    if not len(found):
        return 0, None, None, None, None
    minima = minhash.minima(found)
    odd = np.bincount((found >> np.uint64(13)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return (
        len(found),
        _digest(found),
        minhash.band_keys(minima),
        minima.astype(np.uint8).tobytes(),
        np.packbits(odd.astype(np.uint8)).tobytes(),
    )


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _close(n_a, n_b, signatures_a, signatures_b, sketches_a, sketches_b, threshold: int) -> np.ndarray:
    """Which pairs may be linked; all arguments are arrays of equal length or broadcast to it."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    # 100 i >= t (a + b - i), so the sets differ in a + b - 2 i <= (a + b)(100 - t) / (100 + t)
    sizes = 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    agree = (signatures_a == signatures_b).sum(axis=-1)
    low = threshold / 100 - 5 * np.sqrt(threshold / 100 * (1 - threshold / 100) / (BANDS * ROWS))
    differ = _POPULATION[sketches_a ^ sketches_b].sum(axis=-1, dtype=np.int64)
    return sizes & (agree >= low * BANDS * ROWS) & (differ * (100 + threshold) <= (n_a + n_b) * (100 - threshold))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sieved(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``u, v`` whose signatures and sketches allow a link."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(name) for name in batch.schema.names}
            close = _close(
                c["n_u"].to_numpy(),
                c["n_v"].to_numpy(),
                *[_matrix(c[x], BANDS * ROWS) for x in ("signature_u", "signature_v")],
                *[_matrix(c[x], SKETCH_BITS // 8) for x in ("sketch_u", "sketch_v")],
                threshold,
            )
            yield pa.RecordBatch.from_arrays([c["u"], c["v"]], names=["u", "v"]).filter(pa.array(close))

    sides = pairs
    for side in ("u", "v"):
        own = sketches.select(
            F.col("key").alias(side),
            *[F.col(c).alias(f"{c}_{side}") for c in ("signature", "sketch")],
            F.col("n_shingles").alias(f"n_{side}"),
        )
        sides = sides.join(own, side)
    return sides.mapInArrow(sieve, "u long, v long")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs ``u, v`` of classes whose full shingle sets reach the threshold.

    The text of a class is looked up by key and fingerprint, and taken if it has the class's set.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    ends = stored(classes.join(ends, "class"), "pair-ends")
    place, folder = F.xxhash64("key", "print"), scratch_path(texts.sparkSession, "pair-filter")
    bits = bloom.written(ends.select(place.alias("hash")), folder)
    likely = texts.where(bloom.may_hold(place, folder, bits))
    needed = likely.join(ends, ["key", "print"]).select("class", "set_id", "text").distinct()
    needed = stored(needed, "pair-texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            linked = []
            for at in range(batch.num_rows):
                sets = []
                for side in ("u", "v"):
                    own = batch.column(side)[at].as_py()
                    if own not in known:
                        found = shingles(hashes.of(batch.column(f"text_{side}")[at].as_py()), width)
                        if _digest(found) != batch.column(f"set_{side}")[at].as_py():
                            break
                        if len(known) >= _TEXTS_AT_ONCE:
                            known.clear()
                        known[own] = found
                    sets.append(known[own])
                if len(sets) < 2:
                    linked.append(False)
                    continue
                shared = len(np.intersect1d(*sets, assume_unique=True))
                linked.append(100 * shared >= threshold * (len(sets[0]) + len(sets[1]) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(
                pa.array(linked, pa.bool_())
            )

    sides = pairs
    for side in ("u", "v"):
        own = needed.select(
            F.col("class").alias(side), F.col("set_id").alias(f"set_{side}"), F.col("text").alias(f"text_{side}")
        )
        sides = sides.join(own, side)
    return sides.select("u", "v", "set_u", "set_v", "text_u", "text_v").mapInArrow(confirm, "u long, v long")


def _across(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``u, v`` of different components in a bucket that signatures and sketches allow to be linked.

    ``members`` has ``bucket, size, key, component, n_shingles, signature, sketch``.
    A bucket is dealt into blocks of about ``BLOCK`` rows and each two blocks are
    compared in one task; a bucket of one block moves each row once.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key"), blocks).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(block, other).alias("a"), F.greatest(block, other).alias("b")),
    )
    dealt = members.select("*", block.alias("block"), F.explode(meetings).alias("meeting")).select(
        "bucket", "meeting.*", "block", "key", "component", "n_shingles", "signature", "sketch"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meeting in _meetings(batches):
            pairs = _pairs_across(meeting, threshold)
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["u", "v"]
                )

    return (
        dealt.repartition("bucket", "a", "b")
        .sortWithinPartitions("bucket", "a", "b")
        .mapInArrow(compare, "u long, v long")
        .distinct()
    )


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``bucket, a, b`` of a sorted partition, which may lie in several batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = (pa.concat_tables([rest, table]) if rest else table).combine_chunks()
        if not rest.num_rows:
            continue
        marks = np.stack([rest.column(c).to_numpy() for c in ("bucket", "a", "b")])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
        for first, last in zip(starts, starts[1:]):
            yield rest.slice(first, last - first)
        rest = rest.slice(starts[-1])
    if rest and rest.num_rows:
        yield rest


def _pairs_across(rows: pa.Table, threshold: int) -> np.ndarray:
    """The pairs of one meeting, a row of two keys each."""
    c = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    key, component, n, block = (c[x].to_numpy() for x in ("key", "component", "n_shingles", "block"))
    signature, sketch = _matrix(c["signature"], BANDS * ROWS), _matrix(c["sketch"], SKETCH_BITS // 8)
    a, b = c["a"][0].as_py(), c["b"][0].as_py()
    right, found = np.flatnonzero(block == b), [np.empty((0, 2), np.int64)]
    for at in np.flatnonzero(block == a):
        apart = component[right] != component[at]
        others = right[apart & (key[right] > key[at])] if a == b else right[apart]
        if len(others):
            close = _close(
                n[at : at + 1], n[others], signature[at], signature[others], sketch[at], sketch[others], threshold
            )
            partners = key[others[close]]
            found.append(np.stack([np.full(len(partners), key[at]), partners], axis=1))
    return np.concatenate(found)


def _buckets(rows: DataFrame, *aggregates: Column) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("size"), *aggregates).where("size > 1")


def near_duplicates(
    df: DataFrame, width: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row.

    Words are runs of other characters than space, tab, LF, VT, FF and CR, with A-Z
    lower-cased; a text's set holds its distinct runs of ``width`` words, or of all
    its words if they are fewer. Two texts are linked if their sets share
    ``threshold`` percent of their union or more. ``component_id`` is the smallest
    key reachable, and ``kept`` marks the row with that key. A text without words,
    a null text and a row without key are linked with nothing and kept; the latter
    has no component. Rows of equal key share the smallest component among them and
    do not join the groups of their texts, also where they are a group's smallest key. An empty table gives no rows. Other columns of the input are not read.
    """
    texts = df.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print")
    )
    found = stored(features(texts, width).withColumn("row", F.monotonically_increasing_id()), "features")
    nodes = found.where("key is not null and n_shingles > 0")
    head = F.min(F.struct("key", "print", "row")).alias("head")
    # written before use, so the numbers do not change when a task runs again
    classes = nodes.groupBy("set_id").agg(head).select("set_id", "head.*")
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    heads = nodes.drop("key").join(classes.select("row", F.col("class").alias("key")), "row")
    heads = stored(heads.select("key", "n_shingles", "bands", "signature", "sketch"), "heads")
    sketches = heads.select("key", "n_shingles", "signature", "sketch")
    rows = heads.select(F.explode("bands").alias("bucket"), "key")
    shared = stored(rows.join(_buckets(rows, F.min("key").alias("v")), "bucket").select("bucket", "key", "v"), "shared")
    pairs = shared.where("key != v").select(F.col("key").alias("u"), "v").distinct()
    pairs = stored(pairs, "pairs")
    links = stored(
        _confirmed(stored(_sieved(pairs, sketches, threshold), "sieved"), classes, texts, width, threshold), "links"
    )
    joined = stored(components(links), "components")
    component = F.coalesce("component", "key").alias("component")
    grouped = shared.join(joined.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", component)
    grouped = stored(grouped, "grouped")
    open_buckets = _buckets(grouped, F.min("component").alias("low"), F.max("component").alias("high"))
    members = stored(grouped.join(open_buckets.where("low < high").select("bucket", "size"), "bucket"), "members")
    more = stored(_across(members.join(sketches, "key"), threshold), "pairs-across")
    more = stored(_confirmed(more, classes, texts, width, threshold), "links-across")
    joined = stored(components(links.unionByName(more)), "components")
    placed = classes.join(joined, classes["class"] == joined["node"], "left").drop("node")
    lowest = placed.where("component is not null").groupBy("component").agg(F.min("key").alias("low"))
    of_set = placed.join(stored(lowest, "lowest"), "component", "left").select(
        "set_id", F.coalesce("low", "key").alias("component")
    )
    node = nodes.select("key", "set_id").join(of_set, "set_id").groupBy("key").agg(F.min("component").alias("of_key"))
    result = found.select("key", "n_shingles").join(node, "key", "left")
    component_id = F.coalesce("of_key", "key")
    return result.select(
        F.col("key").alias(key),
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(F.col("key") == component_id, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(
    df: DataFrame, width: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows that :func:`near_duplicates` keeps, with the columns of the input, whatever their names."""
    dropped = near_duplicates(df, width, threshold, key, text).where("not kept").select(F.col(key).alias("key"))
    rows = df.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"))
    return rows.join(stored(dropped.distinct(), "dropped"), "key", "left_anti").select("row.*")
