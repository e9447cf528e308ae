"""The manifest against a plain tree, and its bitmaps against counting."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallymart.llm import merkle_manifest, queries
from tests.conftest import TESTDATA
from tests.llm import plain

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def found(spark, folder) -> Counter:
    return Counter(tuple(r[c] for c in COLUMNS) for r in queries.op12_merkle_manifest(spark, str(folder)).collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table(spark, size):
    rows = pq.read_table(TESTDATA / size / "documents.parquet").to_pylist()
    want = plain.merkle([tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows])
    got = found(spark, TESTDATA / size)
    assert got == want
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(rows)


def odd_rows() -> list[tuple]:
    draws = random.Random(5)
    rows = [(draws.randrange(-(1 << 40), 1 << 40), "far", "x", 1, f"a\nb{k}") for k in range(300)]
    rows += [(draws.randrange(-40, 3000), draws.choice(["a", "b", "", "\u00e9", None]), None, k, None) for k in range(900)]
    rows += [(7, "a", "en", None, f"hot {k}\n") for k in range(700)]  # one key, many texts
    rows += [(7, "a", "en", 2, "same\n")] * 50 + [(None, "a", "en", 2, "same\n")] * 3 + [(None, None, None, None, None)] * 4
    rows += [(2**63 - 1, "ends", "", 0, ""), (-(2**63), "ends", "", 0, "\n" * 9), (5, "lone", "en", 1, "one\n")]
    rows += [(k, "long", "en", 9, "word \n" * 200_000) for k in (1, 2)]
    return rows


def test_nulls_ties_repeated_rows_far_keys_and_clashing_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "_STRETCH", 16)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clashing = df.withColumns({c: F.lit("x") for c in ("group", "key", "place", "leaf", "sides", "n", "chunk", "digest")})
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    assert found(spark, tmp_path) == plain.merkle(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_places_are_ranks(spark):
    """Ranks from the bitmaps equal counting, also at the borders of words and chunks."""
    keys = sorted({k + d for k in (-2048, -1024, -64, 0, 63, 64, 1023, 1024, 4096) for d in (-1, 0, 1)})
    rows = [("g", k, 1 + (k % 3 == 0)) for k in keys] + [("h", k, 1) for k in keys[::2]] + [("h", None, 5)]
    df = spark.createDataFrame(rows, "group string, key long, n long")
    directory = merkle_manifest.rank_directory(merkle_manifest.key_bitmaps(df))
    got = {(r.group, r.key): (r.rank, r.same, r.total) for r in merkle_manifest.ranked(df, directory).collect()}
    for group, key, n in rows:
        own = [r for r in rows if r[0] == group]
        smaller = sum(r[2] for r in own if (r[1] is not None, r[1] or 0) < (key is not None, key or 0))
        assert got[group, key] == (smaller, n, sum(r[2] for r in own))


def test_a_proof_fails_for_another_leaf(spark):
    rows = [(k, f"s{k % 4}", "en", 1, f"text {k}") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = merkle_manifest.manifest(df, merkle_manifest.leaf(F.col("text")))
    ok = whole.select((merkle_manifest.folded(F.col("leaf"), F.col("sides")) == F.col("root")).alias("own"),
                      (merkle_manifest.folded(F.sha2("leaf", 256), F.col("sides")) == F.col("root")).alias("other"))
    assert ok.distinct().collect() == [(True, False)]
