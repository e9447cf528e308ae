"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymart.llm import bloom, bpe, chat, components, exact_dedup, mixing, near_dedup
from tallymart.llm import quality_classifier, quality_rules
from tallymart.llm import piece_counts, queries, token_files, warc
from tallymart.llm.chat_digests import conversation_digests, digests_of_examples
from tallymart.sources.scratch import scratch_path
from tests.llm import plain

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, key string, fp long, row string, n_tokens long, component long"
LONG = " ".join(f"w{k % 9973}" for k in range(60_000))
UNBROKEN = "".join(random.Random(3).choices("abcdeth", k=60_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two",
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich <|endoftext|> ok",
    "line\nline\nline\n" * 5,
    "\x00 ▁ <s>   漢字 😀é",
    LONG,
    UNBROKEN,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Every text twice under its own keys, some rows whole again, null keys and sources, other columns filled."""
    rows = [(2 * k + copy, text, ["a", "b", None][k % 3]) for copy in (0, 1) for k, text in enumerate(TEXTS)]
    rows += [rows[5], rows[5], rows[0], (None, "one two", "a"), (None, None, None)]
    filled = [(key, text, source, "x", 7, "r", -1, None) for key, text, source in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_no_rows_give_no_rows(spark, nothing, tmp_path):
    folder = token_files.write_token_files(nothing, str(tmp_path / "t"), BPE, 2)
    pages = nothing.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    archive = warc.write_warc(pages, str(tmp_path / "w"), "2024-01-01T00:00:00Z")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        mixing.mixed(nothing, {"a": 1, "b": 2}, 2, "s"),
        mixing.mix(nothing, {"a": 1, "b": 2}, 2, "s"),
        near_dedup.near_duplicates(nothing),
        near_dedup.without_near_duplicates(nothing),
        token_files.read_token_files(spark, folder),
        bpe.bpe_round_trip(nothing, BPE),
        exact_dedup.exact_duplicates(nothing),
        exact_dedup.without_exact_duplicates(nothing),
        quality_rules.ledger(nothing),
        quality_rules.passing(nothing),
        conversation_digests(chat.prefix_targets(turns)),
        chat.written_out(chat.prefix_targets(turns)),
        piece_counts.token_counts(nothing, PIECES),
        warc.read_warc(spark, archive),
        components.components(spark.createDataFrame([], "u long, v long")),
    ):
        assert df.collect() == []


def test_mixing_keeps_all_rows_and_places_weighted_ones(odd):
    found = mixing.mixed(odd, {"a": 2, "b": 1, "absent": 9}, 2, "s").collect()
    assert len(found) == odd.count()
    placed = [r for r in found if r.source is not None]
    assert sorted(r.position for r in placed) == list(range(len(placed)))
    assert all(r.slot is None and r.position is None and not r.in_mix for r in found if r.source is None)
    whole = mixing.mix(odd, {"a": 2, "b": 1}, 2, "s")
    assert whole.columns == odd.columns and whole.exceptAll(odd).count() == odd.exceptAll(whole).count() == 0


def test_mix_orders_rows_of_equal_key_alike_however_they_are_dealt(spark):
    rows = [(k % 3 or None, "a", f"text {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = [
        [r.text for r in mixing.mix(df.repartition(parts, F.rand(parts)), {"a": 1}, 2, "s").collect()] for parts in (2, 7)
    ]
    assert order[0] == order[1] and sorted(order[0]) == sorted(t for _, _, t in rows)


def test_mixing_does_not_depend_on_the_number_of_shuffle_partitions(spark, odd):
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "8", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = mixing.mixed(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), {"a": 2, "b": 1}, 2, "s").collect()
        found.append(sorted(map(tuple, rows), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and found[0]


def test_mix_writes_the_stream_in_order(spark, tmp_path):
    df = spark.range(500).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source")
    )
    weights = {"a": 1, "b": 1}
    order = {r.doc_id: r.position for r in mixing.mixed(df, weights, 1, "s").collect()}
    mixing.mix(df, weights, 1, "s").write.parquet(str(tmp_path / "mix"))
    seen = []
    for file in sorted((tmp_path / "mix").glob("part-*.parquet")):
        seen += [order[r.doc_id] for r in spark.read.parquet(str(file)).coalesce(1).collect()]
    assert seen == list(range(500))
    half = mixing.mix(df, weights, 1, "s", whole=False)
    counts = dict(half.groupBy("source").count().collect())
    assert abs(counts["a"] - counts["b"]) <= 1 and min(counts.values()) >= 166


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 5, "c": 7}, {"a": 1, "b": 97, "c": 2, "d": 33}])
def test_schedule_is_earliest_deadline_first(spark, weights):
    period = sum(weights.values())
    want = plain.earliest_deadline_first(weights, {s: a for s, a in weights.items()}, 1)
    found = mixing.schedule(spark, weights).orderBy("slot").collect()
    assert [(r.source, r.turn, r.slot) for r in found] == want and len(found) == period


def test_near_duplicates(odd):
    found = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(found) == odd.count()
    of = plain.components({k: plain.shingles(t, 2) for k, t in plain_rows(odd) if k is not None}, 80)
    for r in found:
        assert r.component_id == of.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == of[r.doc_id])
    kept = near_dedup.without_near_duplicates(odd, width=2)
    assert kept.columns == odd.columns
    assert kept.where("doc_id is null").count() == 2


def test_near_duplicate_families_lose_no_link(spark):
    """Chains and clusters of drifting copies, with a passage that all share."""
    rng, rows = random.Random(11), []
    passage = [f"p{k}" for k in range(60)]
    for family in range(6):
        words = [f"f{family}x{rng.randrange(400)}" for _ in range(150)]
        for _ in range(45):
            words = [w if rng.random() > 0.012 else f"n{rng.randrange(10**6)}" for w in words]
            rows.append(" ".join((passage if rng.random() < 0.5 else []) + words))
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=2).collect()}
    assert found == plain.components({k: plain.shingles(t, 2) for k, t in enumerate(rows)}, 80)


def test_components_of_chains_stars_and_loops(spark):
    rng, edges = random.Random(5), [(k, k + 1) for k in range(200)] + [(500, 500 + k) for k in range(1, 300)]
    edges += [(7, 7), (None, 3), (900, 901), (901, 900)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    sets = {}
    for n, (u, v) in enumerate(edges):
        if u is not None and u != v:
            sets.setdefault(u, set()).add(n)
            sets.setdefault(v, set()).add(n)
    want = plain.components({k: frozenset(s) for k, s in sets.items()}, 0)
    assert found == want


def test_token_files_keep_order_and_nulls(spark, odd, tmp_path):
    folder = token_files.write_token_files(odd, str(tmp_path / "t"), BPE, 2, shards=3)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    tokenizer = plain.byte_bpe()
    want = sorted(plain_rows(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (key, text) in zip(rows, want, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.key, r.start, r.n_tokens) == (key, at, len(ids)) and bytes(r.ids) == plain.packed(ids)
        at += len(ids)


def test_bpe_round_trip_and_decode(odd):
    coded = bpe.bpe_round_trip(odd, BPE).collect()
    tokenizer = plain.byte_bpe()
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in coded) == sorted(
        (k or -1, plain.packed(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in plain_rows(odd)
    )
    encoded = bpe.bpe_encode(odd, BPE).withColumn("ids", F.when(F.col("n_tokens") > 0, F.col("ids")))
    decoded = bpe.bpe_decode(encoded, BPE).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in decoded) == sorted((k or -1, t or "") for k, t in plain_rows(odd))


def test_bpe_as_the_library_on_random_text():
    rng, own = random.Random(17), bpe.ByteBPE.load(open(BPE, "rb").read())
    parts = [" ", "  ", "\n", "\x1c", "\x85", "　", "'s", "'re", "<|endoftext|>", "<|end", "é", "漢", "1", "²", "!!", "😀", "́", "the"]
    parts += [chr(c) for c in (0x558, 0x88F, 0x10D40, 0x2E5D, 0x200B)]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    tokenizer = plain.byte_bpe()
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == plain.packed(found.ids)
        assert own.decode(plain.packed(found.ids)) == tokenizer.decode(found.ids, skip_special_tokens=False)
    broken = plain.packed([own.id_of_byte[0xE6], own.id_of_byte[0xBC]])
    assert own.decode(broken) == tokenizer.decode([own.id_of_byte[0xE6], own.id_of_byte[0xBC]])


def test_exact_duplicates(odd):
    rows = plain_rows(odd)
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len(found) == len(rows)
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    known = {(r.keep_id, r.group_size) for r in found}
    assert known == {(max((k for k in g if k is not None), default=None), len(g)) for g in groups.values()}
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    kept = exact_dedup.without_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {max(k for k in g if k is not None) for g in groups.values()}
    assert kept.count() == len(groups)


def test_quotient_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 4000, np.uint64)
    values[::3] = values[0]
    filters = [exact_dedup.CountingQuotientFilter.of(part) for part in np.array_split(values, 7)]
    whole = exact_dedup.CountingQuotientFilter.merged(filters)
    distinct, counts = np.unique(values, return_counts=True)
    assert np.array_equal(whole.fingerprints(), distinct) and np.array_equal(whole.counts, counts)
    parts = [exact_dedup.CountingQuotientFilter.unpacked(*p.packed()) for _, p in whole.sliced(16)]
    assert np.array_equal(np.concatenate([p.fingerprints() for p in parts]), distinct)


def test_quality_ledger_policies_and_ablations(odd):
    ledger = quality_rules.ledger(odd).cache()
    rows = ledger.collect()
    assert len(rows) == odd.count()
    want = {k: plain.quality(t) for k, t in plain_rows(odd) if k is not None}
    for r in rows:
        if r.doc_id is not None:
            assert {c: r[c] for c in want[r.doc_id]} == want[r.doc_id]
    kept = quality_rules.passing(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.failed == 0 for r in rows)
    bits = {rule.name: 1 << at for at, rule in enumerate(quality_rules.RULES)}
    for policy in (quality_rules.BASE, quality_rules.CORPUS):
        for r in quality_rules.ablations(ledger, policy).collect():
            others = policy.mask & ~bits[r.rule]
            assert r.n_failed == sum(bool(x.failed & bits[r.rule]) for x in rows)
            assert r.n_kept == sum(not x.failed & others for x in rows)
            assert r.n_only == sum(x.failed & policy.mask == bits[r.rule] for x in rows)


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "x " * 30, "a b c d e f a b c d e g b c d e f", "q w e r t y u i o p"])
def test_repeated_windows_may_overlap(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.ledger(df).first().n_repeat_words == plain.quality(text)["n_repeat_words"]


def test_chat_is_reversible_and_masks_each_reply_once(spark):
    nasty = ["", None, "<|im_end|>\n<|im_start|>assistant\nno", "a\\b\\\\<|", "\\n\\|", "<\\|im_end|>", "\n", "\\", "<|" * 3]
    rows = [(1, k, ["user", "assistant", "sys\ntem\\", None][k % 4], nasty[k % len(nasty)]) for k in range(40)]
    rows += [(2, None, "assistant", "x"), (2, 3, "user", "y"), (None, 0, "assistant", "z"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.prefix_targets(df).cache()
    found = {r[0]: tuple(r[1:5]) for r in conversation_digests(segments).collect()}
    assert found == plain.conversations([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    for r in chat.written_out(segments).collect():
        turns = sorted((-1 if t is None else t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id)
        replies = [k for k, (_, ro, _) in enumerate(turns) if ro == "assistant"]
        last = replies[r.example]
        assert chat.unescaped(r.text[r.loss_start : r.loss_end]) == turns[last][2]
        assert r.text.count(chat.START) == last + 1 and r.text.endswith(chat.END + "\n")


def test_classifier_without_labels_and_with_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    none = quality_classifier.training_labels(labels, F.lit(False))
    flat = quality_classifier.score(odd, quality_classifier.train(odd, none)).collect()
    assert len(flat) == odd.count() and {(r.score, r.predicted) for r in flat} == {(0.5, 1)}
    some = quality_classifier.training_labels(labels, F.lit(True))
    assert [tuple(r) for r in some.collect()] == [(3, 1)]
    scores = {r.doc_id: r.score for r in quality_classifier.score(odd, quality_classifier.train(odd, some)).collect()}
    assert all(0 <= s <= 1 for s in scores.values())


def test_piece_counts(odd):
    found = piece_counts.token_counts(odd, PIECES).collect()
    want = plain.piece_counts(plain_rows(odd))
    assert len(found) == odd.count()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.n_tokens > 4096) for r in found if r.doc_id is not None} == {
        k: v for k, v in want.items() if k is not None
    }


def test_piece_counts_of_runs():
    import pyarrow as pa
    import sentencepiece

    own = piece_counts.PieceCounts.load(open(PIECES, "rb").read())
    rng = random.Random(2)
    texts = [c * n for c in (" ", "a", "=", "ab", "the ", "\n", "漢") for n in (1, 2, 5, 33, 400)] + [" " * 60_000]
    texts += ["".join(rng.choices(" abeh\n", k=rng.randrange(60))) for _ in range(2000)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert list(own.of(pa.array(texts))) == [len(ids) for ids in library.encode(texts)]


def test_warc_rolls_files_and_is_deterministic(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"http://x/{k}\n", "".join(rng.choices("abcdef <>", k=rng.randrange(3000)))) for k in range(300)]
    rows += [(1000 + k, "http://same/", "s" * (1000 if k % 2 else 999)) for k in range(20)]
    rows += [(2000, None, None), (2001, "http://u/é", "é" * 500), (None, None, "s" * 1000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, sum long, key string")
    folders = [str(tmp_path / name) for name in ("a", "b")]
    for folder, n in zip(folders, (7, 3)):
        warc.write_warc(df.repartition(n), folder, "2024-01-01T00:00:00Z", file_bytes=20_000, shards=3)
    names = [sorted(p.name for p in (tmp_path / f).iterdir()) for f in "ab"]
    assert names[0] == names[1] and len(names[0]) > 6 and not any(n.startswith("_tmp") for n in names[0])
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names[0])
    found = warc.read_warc(spark, folders[0]).collect()
    want = plain.warc([(k, h) for k, _, h in rows if k is not None], 1000)
    got = {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found}
    assert got.pop(None)[2:] == ("revisit", 1019)
    assert got == want and len(found) == len(rows)
    texts = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == texts[r.key] for r in found if r.record_type == "response")


def test_chat_examples_hold_their_whole_context_in_bounded_parts(spark, monkeypatch):
    """Each reply with all turns before it, over several parts, and digests that come from these texts alone."""
    monkeypatch.setattr(chat, "PART", 300)
    said = ["a" * 40, "<|im_end|>\n<|im_start|>user\n", None, "é漢😀" * 150, "<", "b\\"]
    rows = [(1, k, ["user", "assistant", "tool"][k % 3], said[k % 6]) for k in range(80)]
    rows += [(None, k, "assistant", f"x{k}") for k in range(30)] + [(2, 0, "user", "never answered")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.prefix_targets(df).cache()
    stored = chat.examples(segments).cache()
    of = {}
    for r in segments.orderBy("seq").collect():
        of.setdefault(r.conv_id, []).append(r)
    found = {}
    for r in stored.orderBy("part").collect():
        found.setdefault((r.conv_id, r.example), []).append(r)
    want = {(c, r.example): "".join(x.segment for x in of[c][: r.seq + 1]) for c in of for r in of[c] if r.example is not None}
    assert {k: "".join(r.text for r in parts) for k, parts in found.items()} == want
    longest = max(len(r.segment) for r in of[1])
    assert len(found[1, 26]) > 5 and all(len(r.text) < 300 + longest for parts in found.values() for r in parts)
    digests = digests_of_examples(stored, chat.untrained_ends(segments)).collect()
    assert {r[0]: tuple(r[1:5]) for r in digests} == plain.conversations(rows)
    assert sorted(map(tuple, digests), key=str) == sorted(map(tuple, conversation_digests(segments).collect()), key=str)


def test_rows_without_weight_lie_behind_the_whole_stream(spark, tmp_path):
    """The stream that the pipeline publishes holds the weights first, and says where that ends."""
    sources = [*[f"src{k}" for k in range(20)] * 2, "src0", "src0", "src0", "unlisted", None]
    docs = spark.range(4500).select(
        F.col("id").alias("doc_id"),
        F.lit("a b").alias("text"),
        F.get(F.array(*map(F.lit, sources)), (F.col("id") % len(sources)).cast("int")).alias("source"),
    )
    placed = mixing.mixed(docs, queries.MIX_WEIGHTS, queries.MIX_BLOCK, queries.MIX_SEED)
    placed = {r.doc_id: r for r in placed.collect()}
    path = str(tmp_path / "mix")
    corpus_pipeline.mixing(spark, docs, "").write.parquet(path)
    rows = corpus_pipeline.encoding(spark, spark.read.parquet(path), "").collect()
    rows.sort(key=lambda r: (r.stream_file, r.stream_row))
    weighted = sum(r.position is not None for r in placed.values())
    assert len(rows) == 4500 and weighted == 4300
    assert [placed[r.doc_id].position for r in rows[:weighted]] == list(range(weighted))
    assert all(placed[r.doc_id].position is None for r in rows[weighted:])
    assert [r.in_mix for r in rows] == [placed[r.doc_id].in_mix for r in rows] and 0 < sum(r.in_mix for r in rows) < 4300
    behind = spark.read.parquet(path).where("source is null or source = 'unlisted'")
    assert behind.select("_metadata.file_name").distinct().count() == 1
    many = mixing.mix(docs.withColumn("source", F.lit(None).cast("string")), {"a": 1}, 2, "s")
    assert many.select(F.spark_partition_id()).distinct().count() > 4


def test_near_duplicates_of_a_key_with_two_texts(spark):
    """Each text is linked by its own words, and two texts of one key do not join their groups."""
    words = {name: [f"{name}{k}" for k in range(60)] for name in "abcd"}
    near = {name: [*w[:-1], "other"] for name, w in words.items()}
    rows = [(1, words["a"]), (1, words["b"]), (2, near["a"]), (3, near["b"]), (1, words["a"])]
    rows += [(10, words["c"]), (10, words["d"]), (4, near["c"]), (11, near["d"]), (12, words["d"]), (13, ["lone"])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width=2).collect()}
    ones = {(1, 1, True), (2, 1, False), (3, 1, False)}
    assert found == ones | {(4, 4, True), (10, 4, False), (11, 10, False), (12, 10, False), (13, 13, True)}


def test_near_duplicates_of_a_row_repeated_a_thousand_times(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-2] + ["other", "end"]), "quite different words here"]
    rows = [(k, t) for k, t in enumerate(texts)] * 1000
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found.collect()) == {
        (0, 0, True): 1000,
        (1, 0, False): 1000,
        (2, 2, True): 1000,
    }


def test_the_filter_holds_back_nothing_that_is_in_it(spark):
    small = 1 << 12
    hashes = spark.range(30_000).select(F.xxhash64("id").alias("hash"), "id")
    folder = scratch_path(spark, "filter")
    bits = bloom.written(hashes.where("id % 3 = 0").repartition(4), folder, small)
    passed = {r.id for r in hashes.where(bloom.may_hold(F.col("hash"), folder, bits, small)).collect()}
    assert passed >= set(range(0, 30_000, 3)) and len(passed) < 11_000
    empty = scratch_path(spark, "filter")
    bits = bloom.written(hashes.where("id < 0"), empty)
    assert not hashes.where(bloom.may_hold(F.col("hash"), empty, bits)).count()


def test_bpe_remembers_a_bounded_number_of_chunks_and_words(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 300, raising=False)
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 100, raising=False)
    content = open(BPE, "rb").read()
    own, library = bpe.ByteBPE(content), Tokenizer.from_str(content.decode())
    text = " ".join(f"w{k % 911}x, y{k % 13}" for k in range(5_000))
    assert list(bpe._unpacked(own.encode(text))) == library.encode(text, add_special_tokens=False).ids
    assert len(own._words) + len(own._words.old) <= 600
    assert len(own._chunks) + len(own._chunks.old) <= 200


def test_bpe_merges_new_short_words_side_by_side(monkeypatch):
    rng, content = random.Random(23), open(BPE, "rb").read()
    own, library, one_by_one = bpe.ByteBPE(content), Tokenizer.from_str(content.decode()), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda symbols: one_by_one.append(len(symbols)) or merge(symbols))
    words = ["".join(rng.choices("aeinrst", k=k % 80 + 1)) + rng.choice(["", ".", "é", "'s", "漢", "<|endoftext|>"]) for k in range(4_000)]
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)] + ["", " ", "a" * 61, "a" * 62, "a" * 63]
    packed = list(own.encode_all(texts))
    for text, ids, found in zip(texts, packed, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == plain.packed(found.ids)
    assert list(own.decode_all(packed)) == texts
    assert one_by_one and min(one_by_one) > 62
    assert own.decode(plain.packed([own.id_of_byte[65], 4_000_000_000, own.id_of_byte[66]])) == "AB"


def test_bpe_cuts_stable_text_as_the_pattern_does():
    import regex

    rng, stable = random.Random(29), [chr(c) for c in range(0x250)]
    common = [" ", " ", "\n", "\x1c", "\x85", "\xa0", "'", "'s", "'ll", "'re", "a", "é", "7", "²", "!", "_"]
    cut, whole = bpe.stable_pre_tokens(), regex.compile(bpe.PRE_TOKENS)
    for _ in range(3_000):
        text = "".join(rng.choices(common, k=rng.randrange(20)) + rng.choices(stable, k=rng.randrange(5)) + rng.choices(common, k=4))
        assert cut.findall(text) == whole.findall(text)


def test_token_files_ask_the_library_once_for_each_word(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tallymart.llm.library_ids import LibraryIds

    encoder, asked = LibraryIds(open(BPE, "rb").read()), []
    ask = encoder._of
    monkeypatch.setattr(encoder, "_of", lambda words: asked.extend(words) or ask(words))
    texts = [f"w{'xyz'[k % 3]}, {'ab' * (k % 7)}{mark}<|endoftext|>\nof 漢{mark} " for k in range(50) for mark in ".,;!)"]
    texts += ["", None, "  ", "x" * 200, "x" * 200]
    library = Tokenizer.from_str(open(BPE, "rb").read().decode())
    for kind in (np.dtype("<u2"), np.dtype("<u4")):
        asked.clear()
        for _ in range(2):
            for text, ids in zip(texts, encoder.packed(pa.array(texts), kind), strict=True):
                assert np.frombuffer(ids, kind).tolist() == library.encode(text or "", add_special_tokens=False).ids
        short = [word for word in asked if len(word) <= 64]
        assert len(short) == len(set(short)) < 40


def test_numbered_ids_are_bounded_and_survive_errors():
    import numpy as np

    from tallymart.llm.chunks import Numbered

    def ids(pieces):
        parts = [[int(p.strip("x"))] * (len(p) % 4) for p in pieces]
        return np.array([i for part in parts for i in part], np.int64), np.array([len(p) for p in parts], np.int64)

    def fails(pieces):
        raise ValueError("no ids")

    rng, held = random.Random(31), Numbered("<u2", generation=50)
    for step in range(60):
        documents = [[f"{rng.randrange(200)}" + "x" * rng.choice([0, 1, 2, 70]) for _ in range(rng.randrange(9))] for _ in range(9)]
        if step % 10 == 9:
            with pytest.raises(ValueError):
                list(held.ids_of([["9999", *documents[0]]], fails))
        for document, found in zip(documents, held.ids_of(documents, ids), strict=True):
            assert found.tolist() == ids(document)[0].tolist()
        assert len(held) < 50 and len(held.old) <= 50 and not any(len(p) > 64 for p in held)
