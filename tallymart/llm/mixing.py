"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots of one block. A source of weight ``w = a / W`` has for its k-th
block (from 0) a release slot ``floor(k / w)`` and a deadline ``ceil((k + 1) / w)``.
In each slot the released block with the earliest deadline runs. On one processor
this keeps every source within less than one block of ``w * slots`` at all times.

The weights are whole numbers ``a`` with sum ``W``, so the schedule repeats after W
slots. One period, W rows, is computed; a block's slot then follows from its
number by arithmetic, and a row's position from its block's. Nothing walks over
the rows in order, whatever their number. DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm.quality_rules import let

LARGEST_PERIOD = 10_000
LEAST_BUCKET_DIGITS = 3


def schedule(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """``source, slot, turn, weight, before``: one period; ``before`` counts each source's slots before this one.

    ``turn`` numbers the slots of a source within the period.
    """
    names, parts = list(weights), [int(w) for w in weights.values()]
    period = sum(parts)
    if min(parts, default=0) <= 0 or period > LARGEST_PERIOD:
        raise ValueError(f"weights must be positive and sum to at most {LARGEST_PERIOD}")
    release = lambda k, a: F.floor(k * period / F.lit(a))
    deadline = lambda k, a: -F.floor(-((k + 1) * period) / F.lit(a))

    def step(state: Column, slot: Column) -> Column:
        ready = [
            F.when(
                release(state["done"][s], a) <= slot,
                F.struct(deadline(state["done"][s], a).alias("deadline"), F.lit(s).alias("s")),
            )
            for s, a in enumerate(parts)
        ]
        return let(
            (F.least(*ready) if len(ready) > 1 else ready[0])["s"],
            lambda chosen: F.struct(
                F.transform(state["done"], lambda n, s: n + (s == chosen).cast("long")).alias("done"),
                F.concat(
                    state["runs"], F.array(F.struct(chosen.alias("s"), state["done"].alias("before")))
                ).alias("runs"),
            ),
        )

    start = F.struct(
        F.transform(F.sequence(F.lit(1), F.lit(len(parts))), lambda _: F.lit(0).cast("long")).alias("done"),
        F.expr("cast(array() as array<struct<s: int, before: array<bigint>>>)").alias("runs"),
    )
    runs = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda state: state["runs"])
    rows = spark.range(1).select(F.posexplode(runs).alias("slot", "run"))
    at = F.col("run.s")
    return rows.select(
        at.alias("s"),
        F.array(*map(F.lit, names))[at].alias("source"),
        F.col("slot").cast("long").alias("slot"),
        F.col("run.before")[at].alias("turn"),
        F.array(*map(F.lit, parts))[at].cast("long").alias("weight"),
        F.col("run.before").alias("before"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each ``s`` from 0 in the order of ``dice, key, tie``, as ``number``.

    Rows are counted by ``s`` and the first digits of the dice; sums of these counts
    say where each such bucket begins, so no task sorts a whole source. The rows
    move once, by bucket. A source has sixteen buckets or more for each of the session's
    shuffle partitions, so a source with a third of all rows still spreads over all tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(LEAST_BUCKET_DIGITS, math.ceil(math.log(parts, 16)) + 1)
    rows = rows.withColumn("bucket", F.substring("dice", 1, digits))
    counts = rows.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("s", "bucket", F.expr("sum(n) over (partition by s order by bucket) - n").alias("start"))
    within = F.expr("row_number() over (partition by s, bucket order by dice, key, tie) - 1")
    return (
        rows.withColumn("within", within)
        .join(starts, ["s", "bucket"])
        .withColumn("number", (F.col("start") + F.col("within")).cast("long"))
        .drop("start", "within", "bucket")
    )


@dataclass(frozen=True)
class Mix:
    """Rows with ``source, number, block, slot, position, in_mix``; how many have a position, are in the mix, have none."""

    rows: DataFrame
    size: int
    in_mix: int
    others: int


def _totals(rows: DataFrame, weights: Mapping[str, int]) -> tuple[dict[str, int], int]:
    """The number of rows by ``source`` with a weight, and of those without."""
    listed = F.when(F.col("source").isin(list(weights)), F.col("source")).alias("source")
    counted = rows.groupBy(listed).agg(F.count("*").alias("n"))
    totals = {r["source"]: r["n"] for r in counted.collect()}  # a row for each weight and one more at most
    others = totals.pop(None, 0)
    return {name: totals[name] for name in weights if name in totals}, others


def size_of_mix(df: DataFrame, weights: Mapping[str, int], block: int, source: str = "source") -> int:
    """How many rows of ``df`` are ``in_mix``: so many the stream begins with."""
    totals, _ = _totals(df.select(F.col(source).alias("source")), weights)
    weights = {name: weights[name] for name in totals}
    if not weights:
        return 0
    plan = schedule(df.sparkSession, weights)
    return _first_idle_slot(plan, [n // block for n in totals.values()], sum(weights.values())) * block


def _placed(rows: DataFrame, weights: Mapping[str, int], block: int) -> Mix:
    """Schedule rows that have ``key, source, dice, tie``; rows equal in all four are exchangeable."""
    spark = rows.sparkSession
    totals, others = _totals(rows, weights)
    weights = {name: weights[name] for name in totals}
    if not weights:
        nothing = {c: F.lit(None).cast("long") for c in ("number", "block", "slot", "position")}
        return Mix(rows.withColumns(nothing | {"in_mix": F.lit(False)}), 0, 0, others)
    parts, sizes = list(weights.values()), list(totals.values())
    period = sum(parts)
    plan = schedule(spark, weights)
    idle = _first_idle_slot(plan, [n // block for n in sizes], period)
    index = F.create_map(*[F.lit(x) for s, name in enumerate(weights) for x in (name, s)])
    found = numbered(rows.withColumn("s", F.coalesce(index[F.col("source")], F.lit(-1))))
    weight = F.get(F.array(*[F.lit(a).cast("long") for a in parts]), F.col("s"))
    found = (
        found.withColumn("block", F.floor(F.col("number") / block))
        .withColumn("turn", F.col("block") % weight)
        .withColumn("round", F.floor(F.col("block") / weight))
        .join(F.broadcast(plan.select("s", "turn", F.col("slot").alias("place"), "before")), ["s", "turn"], "left")
    )
    # of each source, the rows in its blocks before this slot; a source that ran out stays at its total
    earlier = [
        F.least(F.lit(n), (F.col("round") * a + F.col("before")[s]) * block)
        for s, (n, a) in enumerate(zip(sizes, parts))
    ]
    slot = F.col("round") * period + F.col("place")
    position = reduce(lambda a, b: a + b, earlier, F.col("number") % block)
    known = F.col("s") >= 0
    return Mix(
        found.withColumns(
            {
                "number": F.when(known, F.col("number")),
                "block": F.when(known, F.col("block")),
                "slot": F.when(known, slot).cast("long"),
                "position": F.when(known, position).cast("long"),
                "in_mix": F.coalesce(known & (slot < idle), F.lit(False)),
            }
        ),
        sum(sizes),
        idle * block,
        others,
    )


def _first_idle_slot(plan: DataFrame, full: list[int], period: int) -> int:
    """The first slot whose source has no full block left; up to there the weights hold."""
    left = F.array(*[F.lit(n).cast("long") for n in full])[F.col("s")] - F.col("turn")
    rounds = F.greatest(F.ceil(left / F.col("weight")), F.lit(0))
    return plan.agg(F.min(rounds * period + F.col("slot"))).first()[0]


def mixed(
    df: DataFrame,
    weights: Mapping[str, int],
    block: int,
    seed: str,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``key, source, number, block, slot, position, in_mix`` for each row.

    ``weights`` are whole parts by source. Within a source rows come in the order
    of ``md5(seed:key)``, then key. ``position`` is the place in the mixed stream of
    all rows. A source that runs out leaves its slots to nobody: the others close
    up and keep their weights among themselves. ``in_mix`` marks the stream up to
    the first slot without a full block, where every prefix holds every target
    weight to within less than one block. Weights are shares among the sources that
    have rows. Rows of a source without weight, null included, have no slot and no
    position. Rows of equal key (null: one key) are
    numbered in any order. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), _dice(seed, key), F.lit(0).alias("tie"))
    found = _placed(rows, weights, block).rows
    return found.select(
        F.col("key").alias(key), F.col("source").alias(source), "number", "block", "slot", "position", "in_mix"
    )


def mix(
    df: DataFrame,
    weights: Mapping[str, int],
    block: int,
    seed: str,
    key: str = "doc_id",
    source: str = "source",
    whole: bool = True,
) -> DataFrame:
    """The rows as a mixed stream, in the order of ``position`` over the files that a write makes.

    Each partition takes an equal range of positions and is sorted. With ``whole``
    all rows stay: what a source has beyond its weight ends the stream, and rows
    without position lie behind it in partitions of their own, dealt by a hash of all their
    columns. Else only the rows that are ``in_mix`` stay. The columns are the input's, whatever their names. Rows of
    equal key come in the order of a hash of all their columns, so a task that runs
    again after a lost executor deals them out as it did before.
    """
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        _dice(seed, key),
        F.xxhash64(F.to_json(F.struct("*"))).alias("tie"),
    )
    placed = _placed(rows, weights, block)
    found, size = (placed.rows, placed.size) if whole else (placed.rows.where("in_mix"), placed.in_mix)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    behind = math.ceil(parts * placed.others / (placed.size + placed.others)) if whole and placed.others else 0
    part = F.floor(F.col("position") * parts / max(size, 1))
    if behind:
        part = F.coalesce(part, parts + F.pmod("tie", F.lit(behind)))
    return (
        found.select("row", "position", "tie", part.cast("int").alias("part"))
        .repartitionById(parts + behind, "part")
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "tie")
        .select("row.*")
    )


def _dice(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("dice")
