"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: its context is all turns before
it, and only its text is trainable. A conversation is formatted once, in one segment
for each turn, and an example is a span of it: it begins at 0, its loss span lies
within the segment of its turn, and it ends with that segment. :func:`examples` writes
these spans out as text.

A segment is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. A
backslash marks what texts and roles must not say themselves: ``\\`` becomes
``\\\\``, ``<|`` becomes ``<\\|``, and a line feed in a role becomes ``\\n``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Code points of a conversation whose segments make one part of an example's text.
PART = 1 << 16
_TAIL = f"{END}\n"
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    """The inverse of :func:`escaped`, also for roles."""
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def turn_of(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    role, found, text = segment.removeprefix(START).partition("\n")
    if not (segment.startswith(START) and found and text.endswith(_TAIL)):
        raise ValueError("not a segment")
    return unescaped(role), unescaped(text.removesuffix(_TAIL))


def segments_of(text: str) -> list[str]:
    """The segments of a text made of whole ones."""
    found = text.split(_TAIL)
    if found.pop():
        raise ValueError("not a whole number of segments")
    return [segment + _TAIL for segment in found]


def prefix_targets(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, seq, segment, start, example, loss_start, loss_end`` for each turn.

    ``seq`` numbers a conversation's turns from 0 by turn (null first), then role and
    text. ``start`` is where the segment begins in the conversation, in code points.
    Turns of role ``assistant`` are examples, numbered from 0: the example's input
    is the conversation up to the end of the segment, its loss the code points from
    ``loss_start`` to ``loss_end``. Other turns have null there. A null text or role
    counts as empty; rows without conversation id form one conversation. Repeated
    rows are turns of their own. An empty table gives no rows.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(by), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = df.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        by.alias("role"),
        F.concat(head, escaped(said), F.lit(_TAIL)).alias("segment"),
        F.length(head).alias("head"),
    ).withColumn("size", F.length("segment").cast("long"))
    order = "partition by conv_id order by turn, role, segment rows between unbounded preceding and current row"
    start = F.expr(f"sum(size) over ({order}) - size")
    trained = F.col("role") == TRAINED_ROLE
    example = F.expr(f"sum(int(role = '{TRAINED_ROLE}')) over ({order}) - 1")
    placed = rows.select(
        "conv_id",
        F.expr(f"count(*) over ({order}) - 1").alias("seq"),
        "segment",
        start.alias("start"),
        F.when(trained, example).alias("example"),
        "head",
        "size",
    )
    begin = F.col("start") + F.col("head")
    return placed.select(
        "conv_id",
        "seq",
        "segment",
        "start",
        "example",
        F.when(F.col("example").isNotNull(), begin).alias("loss_start"),
        F.when(F.col("example").isNotNull(), F.col("start") + F.col("size") - len(_TAIL)).alias("loss_end"),
    )


def untrained_ends(segments: DataFrame) -> DataFrame:
    """The segments behind the last example of each conversation, which no example holds."""
    last = segments.where("example is not null").groupBy(F.col("conv_id").alias("c")).agg(F.max("seq").alias("last"))
    behind = segments.join(last, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return behind.where("last is null or seq > last").select(segments.columns)


def examples(segments: DataFrame) -> DataFrame:
    """``conv_id, example, part, part_start, text, since, loss_start, loss_end``: each example's input as text, in parts.

    The input of an example is the texts of its parts in order, from code point 0 to the
    end of its turn. A part holds the segments that begin in one range of ``PART`` code
    points, so no group grows with its conversation: parts are put together once and
    joined to the examples that reach them, by conversation and part. What begins at
    ``since`` is new, the context before it was there in the example before. The text
    written grows with the square of a conversation's length, as the method does.
    """
    part = F.floor(F.col("start") / PART)
    spoken = F.array_sort(F.collect_list(F.struct("seq", "segment")))
    parts = (
        segments.select("conv_id", part.alias("part"), "seq", "segment", "start")
        .groupBy("conv_id", "part")
        .agg(F.min("start").alias("part_start"), F.array_join(F.transform(spoken, lambda p: p["segment"]), "").alias("whole"))
        .withColumnsRenamed({"conv_id": "c", "part": "p"})
    )
    targets = segments.where("example is not null").select(
        "conv_id", "example", "loss_start", "loss_end", (F.col("loss_end") + len(_TAIL)).alias("end"), part.alias("last")
    )
    earlier = targets.select(F.col("conv_id").alias("e"), (F.col("example") + 1).alias("next"), F.col("end").alias("since"))
    follows = F.col("conv_id").eqNullSafe(F.col("e")) & (F.col("example") == F.col("next"))
    reached = targets.join(earlier, follows, "left").select(
        "conv_id",
        "example",
        F.coalesce("since", F.lit(0).cast("long")).alias("since"),
        "loss_start",
        "loss_end",
        "end",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("part"),
    )
    found = reached.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    text = F.substring("whole", F.lit(1), F.least(F.length("whole"), F.col("end") - F.col("part_start")).cast("int"))
    return found.select(
        "conv_id", "example", "part", "part_start", text.alias("text"), "since", "loss_start", "loss_end"
    )


def written_out(segments: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: each example with its whole input in one cell."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    return (
        examples(segments)
        .groupBy("conv_id", "example", "loss_start", "loss_end")
        .agg(text.alias("text"))
        .select("conv_id", "example", "text", "loss_start", "loss_end")
    )
