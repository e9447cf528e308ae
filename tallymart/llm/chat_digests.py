"""Digests of formatted conversations, read back from the examples or the segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.chat import segments_of, turn_of, unescaped

DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_ROWS_AT_ONCE = 4096


class _Conversation:
    """Digests of one conversation, fed with its segments in order; holds no text."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, start: int, loss_start: int | None, loss_end: int | None) -> None:
        """Take the segments of ``text``; the loss span, if any, lies in the last one."""
        if start != self.chars:
            raise ValueError("a segment is missing")
        for segment in segments_of(text):
            role, said = turn_of(segment)
            self.all.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            self.chars += len(segment)
        if loss_start is not None:
            trained = unescaped(text[loss_start - start : loss_end - start])
            self.loss.update(trained.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(trained)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation: its turns and the text under the loss mask, unescaped, as digests.

    A digest of a whole conversation must pass over it in order; the segments of a
    conversation therefore stream through one task, which keeps two hash states.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, *segment in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Conversation(conv_id)
                now.add(*segment)
            if len(done) >= _ROWS_AT_ONCE:
                yield _batch(done)
                done = []
        yield _batch(done + ([now.row()] if now else []))

    rows = segments.select(
        F.col("conv_id").cast("long"), F.col("segment").alias("text"), "start", "loss_start", "loss_end"
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(digest, DIGEST_SCHEMA)


def digests_of_examples(written: DataFrame, ends: DataFrame) -> DataFrame:
    """The same digests from the text of ``examples``, and the ``untrained_ends`` that no example holds.

    Of each example what the one before did not hold is read, and the loss span in its last part.
    """
    new = F.greatest(F.col("since") - F.col("part_start"), F.lit(0))
    begin = F.col("part_start") + new
    end = F.col("part_start") + F.length("text")
    trained = (F.col("loss_start") >= begin) & (F.col("loss_end") <= end)
    fresh = written.where(end > F.col("since")).select(
        "conv_id",
        F.substring("text", (new + 1).cast("int"), F.length("text")).alias("segment"),
        begin.alias("start"),
        F.when(trained, F.col("loss_start")).alias("loss_start"),
        F.when(trained, F.col("loss_end")).alias("loss_end"),
    )
    return conversation_digests(fresh.unionByName(ends.select(fresh.columns)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in DIGEST_SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
