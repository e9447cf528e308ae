"""Each registered query over whole test tables against a plain computation."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import queries
from tallymart.llm.mixing import mixed
from tests.conftest import TESTDATA
from tests.llm import plain

FOLDER = TESTDATA / "sf0.01"


def table(name: str) -> list[dict]:
    return pq.read_table(FOLDER / f"{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts() -> list[tuple[int, str | None]]:
    return [(r["doc_id"], r["text"]) for r in table("documents")]


def result(spark, query, *columns: str) -> dict:
    rows = [tuple(r[c] for c in columns) for r in query(spark, str(FOLDER)).collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1_is_earliest_deadline_first(spark):
    found = queries.op1_pfair_mix(spark, str(FOLDER)).collect()
    documents = table("documents")
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in documents)
    order = {}
    for r in documents:
        dice = hashlib.md5(f"{queries.MIX_SEED}:{r['doc_id']}".encode()).hexdigest()
        order.setdefault(r["source"], []).append((dice, r["doc_id"]))
    for rows in order.values():
        rows.sort()
    sizes = {s: len(order[s]) for s in queries.MIX_WEIGHTS}
    blocks = plain.earliest_deadline_first(queries.MIX_WEIGHTS, sizes, queries.MIX_BLOCK)
    want, position = {}, 0
    idle = first_idle(blocks, sizes)
    for source, block, slot in blocks:
        first = block * queries.MIX_BLOCK
        for _, doc_id in order[source][first : first + queries.MIX_BLOCK]:
            want[doc_id] = (source, block, slot, position, slot < idle)
            position += 1
    assert {r["doc_id"]: (r["source"], r["block"], r["slot"], r["position"], r["in_mix"]) for r in found} == want


def first_idle(blocks, sizes) -> int:
    filled = {slot for s, k, slot in blocks if (k + 1) * queries.MIX_BLOCK <= sizes[s]}
    return next(slot for slot in range(max(filled) + 2) if slot not in filled)


def test_op1_prefixes_hold_the_weights(spark):
    found = queries.op1_pfair_mix(spark, str(FOLDER)).where("in_mix").collect()
    blocks = sorted({(r["slot"], r["source"]) for r in found})
    period, done = sum(queries.MIX_WEIGHTS.values()), dict.fromkeys(queries.MIX_WEIGHTS, 0)
    for n, (slot, source) in enumerate(blocks, 1):
        assert slot == n - 1
        done[source] += 1
        assert all(abs(done[s] * period - n * w) < period for s, w in queries.MIX_WEIGHTS.items())


def test_op2_is_the_components_of_all_links(spark, texts):
    found = result(spark, queries.op2_minhash, "doc_id", "n_shingles", "component_id", "kept")
    sets = {k: plain.shingles(t, 2) for k, t in texts}
    of = plain.components(sets, 80)
    assert found == {k: (len(sets[k]), of[k], of[k] == k) for k in sets}


def test_op3_files_hold_the_library_ids(spark, texts):
    found = result(spark, queries.op3_token_files, "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == plain.token_file(texts, queries.END_ID)


def test_op4_codes_as_the_library(spark, texts):
    found = result(spark, queries.op4_bpe, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == plain.round_trips(texts)


def test_op5_keeps_the_largest_of_equal_texts(spark, texts):
    found = result(spark, queries.op5_exact_dedup, "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == plain.exact(texts)


def test_op6_measures(spark, texts):
    rows = queries.op6_quality_rules(spark, str(FOLDER)).collect()
    assert len(rows) == len(texts)
    want = {k: plain.quality(t) for k, t in texts}
    for r in rows:
        m = want[r["doc_id"]]
        assert {c: r[c] for c in m} == m
        base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])


def test_op6_keeps_clean_documents_and_drops_junk(spark):
    quality = {r["doc_id"]: r["quality"] for r in table("labels")}
    rows = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, str(FOLDER)).collect()}
    for doc_id, label in quality.items():
        if label:
            assert rows[doc_id]["kept"] or rows[doc_id]["base_failed"]
    junk = [rows[k]["kept"] for k, label in quality.items() if not label]
    assert sum(junk) <= 0.02 * len(junk)


def test_op7_reads_back_what_was_said(spark):
    found = result(spark, queries.op7_chat_format, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    said = "<|im_end|><|im_start|>assistant ok"
    assert found == plain.conversations([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_op8_held_out_accuracy(spark, texts):
    rows = queries.op8_quality_classifier(spark, str(FOLDER)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(k for k, _ in texts)
    quality = {r["doc_id"]: r["quality"] for r in table("labels")}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r["predicted"] == quality[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)


def test_op9_counts_as_the_library(spark, texts):
    found = result(spark, queries.op9_token_counts, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert found == plain.piece_counts(texts)


def test_op10_reads_back_the_pages(spark):
    found = result(
        spark, queries.op10_warc, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert found == plain.warc([(r["page_id"], r["html"]) for r in table("pages")], 1000)


def test_pipeline_against_plain_stages(spark):
    documents = {r["doc_id"]: r for r in table("documents")}
    policy = {r["doc_id"] for r in queries.op6_quality_rules(spark, str(FOLDER)).where("kept").collect()}
    kept = {k: r["text"] for k, r in documents.items() if k in policy}
    kept = {k: kept[k] for k, row in plain.exact(list(kept.items())).items() if row[2]}
    of = plain.components({k: plain.shingles(t, 5) for k, t in kept.items()}, 80)
    kept = {k: t for k, t in kept.items() if of[k] == k}
    found = result(spark, corpus_pipeline.run, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == plain.round_trips(list(kept.items()))
    assert 0 < len(found) < len(documents)


def test_pipeline_result_carries_the_mixed_order(spark):
    rows = corpus_pipeline.run(spark, str(FOLDER)).select("doc_id", "stream_file", "stream_row").collect()
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["stream_file"], r["stream_row"]))]
    docs = spark.read.parquet(str(FOLDER / "documents.parquet")).where(F.col("doc_id").isin(order))
    expected = mixed(docs, queries.MIX_WEIGHTS, queries.MIX_BLOCK, queries.MIX_SEED).where("position is not null")
    placed = [r["doc_id"] for r in expected.orderBy("position").collect()]
    known = set(placed)
    assert [d for d in order if d in known] == placed and len(placed) > 100


def test_the_last_stage_takes_rows_from_no_file(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = corpus_pipeline.encoding(spark, docs, str(FOLDER)).first()
    assert (row["doc_id"], row["stream_file"], row["stream_row"]) == (1, None, None)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(FOLDER)).schema == docs.schema


def test_two_runs_of_the_pipeline_give_equal_rows(spark):
    first, second = (corpus_pipeline.run(spark, str(FOLDER)).drop("ids").collect() for _ in range(2))
    assert sorted(first) == sorted(second)
    assert len({(r["stream_file"], r["stream_row"]) for r in first}) == len(first)
