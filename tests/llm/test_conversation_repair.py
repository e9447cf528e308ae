"""Conversation repair against plain search, in stretches and whole."""

from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest

from tallymart.llm import conversation_repair, queries, repair_search
from tests.conftest import TESTDATA
from tests.llm import plain

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def by_conversation(df) -> dict:
    rows = df.select(COLUMNS).collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table(spark, size):
    table = pq.read_table(TESTDATA / size / "conversations.parquet")
    rows = list(zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))))
    want = {conv: plain.conversation_audit(turns) for conv, turns in plain.damaged(rows).items()}
    assert by_conversation(queries.op13_conversation_repair(spark, str(TESTDATA / size))) == want
    assert sum(w[5] for w in want.values()) > 0


def odd_rows() -> list[tuple]:
    draws = random.Random(13)
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "No", " \t\n", "", None, "Why?", "Well!\x0b ", " ", "Äh", "a. "]
    rows = [
        (conv, draws.choice([None, *range(6)]), draws.choice(roles[: draws.choice([2, 3, 7])]), draws.choice(texts))
        for conv in (*range(60), None)
        for _ in range(draws.randrange(1, 9))
    ]
    return rows + [(70, None, None, None), (71, 2**40, "user", "x" * 300_000), (72, -5, "assistant", "a.")] * 2


def test_odd_rows_and_clashing_columns(spark, tmp_path, monkeypatch):
    """Nulls in every column, other roles, ties, repeated rows; columns named as the operator's own."""
    rows = odd_rows()
    want = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        want.setdefault(conv, []).append((turn, role, text))
    want = {conv: plain.conversation_audit(turns) for conv, turns in want.items()}
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", at int, audit string, tie binary")
    assert by_conversation(conversation_repair.audits(df.repartition(5))) == want
    # cut into stretches of two, joined in three or more levels
    monkeypatch.setattr(conversation_repair, "STRETCH_BITS", 1)
    monkeypatch.setattr(conversation_repair, "JOINED_AT_ONCE", 2)
    assert by_conversation(conversation_repair.audits(df.repartition(3))) == want


def test_damage_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {conv: plain.conversation_audit(turns) for conv, turns in plain.damaged(rows).items()}
    assert by_conversation(queries.op13_conversation_repair(spark, str(tmp_path))) == want
    # a conversation of which every row is dropped
    gone = next(k for k in range(10_000) if not plain.damaged([(k, 0, "user", "a.")])[k])
    path = tmp_path / "gone"
    spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA).write.parquet(str(path / "conversations.parquet"))
    found = by_conversation(queries.op13_conversation_repair(spark, str(path)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.audits(empty).collect() == []
    assert conversation_repair.repaired(empty).collect() == []


def test_repaired_rows_make_the_digest(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    lines = {}
    for conv, _, edit, role, text in sorted(
        conversation_repair.repaired(df).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1])
    ):
        assert edit in "KRI"
        lines.setdefault(conv, []).append(f"{role}:{text}")
    for conv, found in by_conversation(conversation_repair.audits(df)).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == found[-1]


def test_one_long_conversation(spark):
    """5,000 rows of one conversation, in several stretches."""
    draws = random.Random(5)
    rows = [(7, k, draws.choice(["user", "assistant"]), draws.choice([f"{k}.", f"{k}", "Again."])) for k in range(5000)]
    want = plain.conversation_audit([r[1:] for r in rows])
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert by_conversation(conversation_repair.audits(df)) == {7: want}


@pytest.mark.parametrize("length", [0, 1, 2, 5, 12, 40])
def test_search_is_exact_and_stretches_join(length):
    draws = random.Random(length)
    faults = {"b": "blank", "d": "duplicate"}
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    for _ in range(60):
        codes = "".join(draws.choices("suaxdSUAX", k=length))
        rows = [(roles[c.lower()], "t", faults.get(c, "truncated" if c.isupper() else None)) for c in codes]
        assert repair_search.search(codes) == plain.cheapest_repair(rows)[:2]
        cut = draws.randrange(length + 1)
        parts = repair_search.table(codes[:cut]), repair_search.table(codes[cut:])
        assert repair_search.joined(*parts) == repair_search.table(codes)
