"""The operators as queries over the corpus tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import conversation_repair, merkle_manifest, quality_rules
from tallymart.llm.bpe import bpe_round_trip
from tallymart.llm.chat import examples, prefix_targets, untrained_ends
from tallymart.llm.chat_digests import digests_of_examples
from tallymart.llm.exact_dedup import exact_duplicates
from tallymart.llm.line_dedup import without_common_lines
from tallymart.llm.mixing import mixed
from tallymart.llm.near_dedup import near_duplicates
from tallymart.llm.piece_counts import token_counts
from tallymart.llm.quality_classifier import score, train, training_labels
from tallymart.llm.tables import corpus, stored
from tallymart.llm.token_files import read_token_files, write_token_files
from tallymart.llm.warc import read_warc, write_warc
from tallymart.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
TOKEN_LIMIT = 4096
#: Thousandths of the mixed stream by source.
MIX_WEIGHTS = {"src0": 145} | {f"src{k}": 45 for k in range(1, 20)}
MIX_BLOCK = 4
MIX_SEED = "mix-1"
#: Lines of at least so many code points in at least so many documents go.
LINE_DOCUMENTS, LINE_CHARS = 10, 1
WARC_DATE = "2024-01-01T00:00:00Z"


def op1_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(corpus(spark, folder), MIX_WEIGHTS, MIX_BLOCK, MIX_SEED)


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(corpus(spark, folder), width=2, threshold=80)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    files = write_token_files(corpus(spark, folder), scratch_path(spark, "token-files"), path, END_ID)
    return read_token_files(spark, files).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe_round_trip(corpus(spark, folder), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(corpus(spark, folder))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("failed")
    return quality_rules.ledger(corpus(spark, folder)).select(
        "*",
        (~quality_rules.passes(failed, quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(failed, quality_rules.CORPUS).alias("kept"),
    )


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = corpus(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    segments = stored(prefix_targets(turns.unionByName(own)), "chat")
    return digests_of_examples(stored(examples(segments), "examples"), untrained_ends(segments))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = corpus(spark, folder)
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(documents, training_labels(corpus(spark, folder, "labels"), remainder != 1))
    return score(documents, model).select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(corpus(spark, folder), public_tokenizers.path(PIECES))
    return counts.select("*", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    files = write_warc(corpus(spark, folder, "pages"), scratch_path(spark, "warc"), WARC_DATE)
    return read_warc(spark, files, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = without_common_lines(corpus(spark, folder), LINE_DOCUMENTS, LINE_CHARS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = corpus(spark, folder)
    rest = [F.col(c) for c in ("source", "lang", "n_chars")]
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    own, changed = (merkle_manifest.leaf(F.col("doc_id"), *rest, text) for text in (F.col("text"), flat))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed).otherwise(own)
    rows = merkle_manifest.manifest(documents, own, tampered=tampered)
    rows = rows.withColumn("folded_root", merkle_manifest.folded(F.col("tampered"), F.col("sides")))
    return rows.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle_manifest.proof(F.col("sides")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fault planted in a quarter of their rows; nulls become one space first."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(parts[3], ".!?", "")).otherwise(parts[3])
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(parts[2]).alias("role"),
        text.alias("text"),
        fault.alias("fault"),
    )
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault != 0").withColumn("copy", F.explode(copies)).drop("fault", "copy")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = corpus(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.audits(damaged(turns)).withColumnRenamed("conv_id", "found_id")
    every = turns.select(F.col("conv_id").cast("long")).distinct()
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(
        "conv_id",
        *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def registered() -> dict[str, Query]:
    own = [
        op1_pfair_mix,
        op2_minhash,
        op3_token_files,
        op4_bpe,
        op5_exact_dedup,
        op6_quality_rules,
        op7_chat_format,
        op8_quality_classifier,
        op9_token_counts,
        op10_warc,
        op11_line_dedup,
        op12_merkle_manifest,
        op13_conversation_repair,
    ]
    return {query.__name__: query for query in own}
