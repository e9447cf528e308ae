"""The corpus pipeline: documents to token ids, in five stages.

Every stage but the last returns the columns of its input, so stages can be run
alone, written between each other, or all at once by :func:`run`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm.bpe import bpe_round_trip
from tallymart.llm.exact_dedup import without_exact_duplicates
from tallymart.llm.mixing import mix, size_of_mix
from tallymart.llm.near_dedup import without_near_duplicates
from tallymart.llm.quality_rules import CORPUS, passing
from tallymart.llm.queries import BYTE_BPE, MIX_BLOCK, MIX_SEED, MIX_WEIGHTS
from tallymart.llm.tables import corpus, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the corpus policy."""
    return passing(docs, CORPUS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as the mixed stream: the order of files and rows is the order of training.

    Nothing is dropped. A source that holds more than its weight ends the stream. The last
    stage reads a document's place in the stream back from the files.
    """
    return mix(docs, MIX_WEIGHTS, MIX_BLOCK, MIX_SEED)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, digests of ids and of the text decoded from them, and its place in the stream.

    ``stream_file, stream_row`` sort the documents as the mixing wrote them: the file's name
    without its run's random part, and the row's number in it. ``in_mix`` marks the beginning of the stream that holds all
    weights; behind it lies what sources have beyond theirs, then the sources without
    weight. Rows that do not come from files have null there.
    """
    place = docs.select(F.struct("doc_id", *_place(docs)).alias("at"), "text")
    coded = bpe_round_trip(place, public_tokenizers.path(BYTE_BPE), key="at")
    return coded.select(
        "at.*",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: What a writer puts into file names to tell its runs apart.
_RUN = "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def _place(docs: DataFrame) -> list[Column]:
    """Where a row lies in the files that ``docs`` reads, without a shuffle or a numbering."""
    parts = {"stream_file": ("file_name", "string"), "stream_row": ("row_index", "long")}
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        kinds = {name: kind for name, (_, kind) in parts.items()} | {"in_mix": "boolean"}
        return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    file, row = [F.col(f"_metadata.{field}").cast(kind) for field, kind in parts.values()]
    last, rows = _end_of_mix(docs)
    in_mix = (file < last) | ((file == last) & (row < rows))
    return [F.regexp_replace(file, _RUN, "").alias("stream_file"), row.alias("stream_row"), in_mix.alias("in_mix")]


def _end_of_mix(docs: DataFrame) -> tuple[str, int]:
    """The file in which the mix ends, and how many of its rows belong to it."""
    left = size_of_mix(docs, MIX_WEIGHTS, MIX_BLOCK)
    counts = docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    for file, n in sorted(map(tuple, counts.collect())):  # a row for each file
        if left <= n:
            return file, left
        left -= n
    return "", 0


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("pfair_mix", mixing),
    ("bpe", encoding),
]

#: MinHash components and BPE have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written before the next begins."""
    docs = corpus(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
