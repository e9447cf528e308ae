"""Line dedup against plain counting, and the perfect hash behind it."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallymart.llm import line_dedup, queries
from tallymart.llm.perfect_hash import PerfectHash
from tallymart.llm.shared_files import Folder
from tests.conftest import TESTDATA
from tests.llm import plain


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table(spark, size):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(TESTDATA / size / "documents.parquet").to_pylist()]
    want = plain.line_dedup(rows, queries.LINE_DOCUMENTS, queries.LINE_CHARS)
    want = Counter({(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()): n for r, n in want.items()})
    found = queries.op11_line_dedup(spark, str(TESTDATA / size)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == want
    assert 0 < sum(r[2] for r in want)


@pytest.mark.parametrize(("least", "chars"), [(1, 1), (2, 1), (3, 4), (300, 0)])
def test_odd_rows(spark, least, chars):
    """Nulls, empty and long texts, repeated rows, a line of a third of all rows, borders of white space and case."""
    draws = random.Random(least)
    lines = ["", " ", "Ab c", "\tab C\r", "\u00c4b", "\u00e4b", "x", "\u00a0x", "\U0001f600", "abc", "abcd\x0b"]
    rows = [(k, "\n".join(draws.choices(lines, k=draws.randrange(1, 9)))) for k in range(300)]
    rows += [(k, f"hot line\nown {k}\r\n") for k in range(300, 700)]
    rows += [(1, None), (None, ""), (None, None), (2, "\n".join(f"l{k % 60_000}" for k in range(200_000)))] * 2
    df = spark.createDataFrame([(k, t, "x", 1, b"y") for k, t in rows], "doc_id long, text string, print string, n int, drop binary")
    found = line_dedup.without_common_lines(df.repartition(5), least, chars)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, found.collect())) == plain.line_dedup(rows, least, chars)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_common_lines(df, 10).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.without_common_lines(empty, 1).collect()} == {(1, 1, 0, ""), (2, 1, 0, "")}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_numbers_every_key_once_whatever_the_order(n):
    draws = np.random.default_rng(n)
    high, low = draws.integers(0, 2**64, (2, n), np.uint64)
    low[: n // 2] = low[0] if n else 0  # one half may be equal
    index = PerfectHash.of(high, low)
    assert len(index) == n and sorted(index.numbers(high, low)) == list(range(n))
    order = draws.permutation(n)
    assert np.array_equal(PerfectHash.of(high[order], low[order]).words, index.words)
    if n > 100:
        assert 8 * index.words.nbytes < 4.5 * n
        with pytest.raises(ValueError):
            PerfectHash.of(np.append(high, high[0]), np.append(low, low[0]))


def test_a_shard_reads_back_and_rejects_other_lines(tmp_path):
    draws = np.random.default_rng(1)
    high, low = draws.integers(0, 2**64, (2, 5001), np.uint64)
    n = draws.integers(1, 1000, 5001)
    folder = Folder(str(tmp_path)).made()
    line_dedup.Shard.of(high, low, n, np.dtype("u1")).written(folder, "a")
    shard = line_dedup.Shard.read(folder, "a")
    assert np.array_equal(shard.count(high, low), np.minimum(n, 255))
    assert not shard.count(high, low + np.uint64(1)).any()
