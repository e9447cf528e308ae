"""Reproducible random draws: pure functions of a seed, a draw number and a row key.

A draw never depends on the partition a row sits in, so generated data is the
same on any cluster size and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime. Products of two residues fit into 62 bits, so plain bigints do.
DRAW_SPAN = 2**31 - 1

#: Multipliers and shifts of the rounds; any large residues would do.
ROUNDS = ((1_597_334_677, 15), (1_103_515_245, 13), (1_812_433_253, 16))
SEED_STEP, DRAW_STEP, HIGH_STEP = 69_621, 48_271, 39_373


def draw(key: str, seed: int, number: int) -> Column:
    """A pseudo-random bigint in ``0 .. DRAW_SPAN - 1``.

    The key's two halves, the seed and the draw number are added up modulo the
    prime; each round multiplies and folds the high bits onto the low ones.
    """
    start = ((seed + 1) * SEED_STEP + (number + 1) * DRAW_STEP * 65_537) % DRAW_SPAN
    whole = F.col(key).cast("bigint")
    high = F.floor(whole / F.lit(DRAW_SPAN)).cast("bigint")
    value = (whole % DRAW_SPAN + high % DRAW_SPAN * HIGH_STEP + F.lit(start)) % DRAW_SPAN
    for factor, shift in ROUNDS:
        value = (value * F.lit(factor) + F.lit(number + 1)) % DRAW_SPAN
        value = value.bitwiseXOR(F.shiftright(value, shift)) % DRAW_SPAN
    return value


def wide(high: Column, low: Column) -> Column:
    """Two draws as one of more than 61 bits, for ranges beyond two billion."""
    return high * DRAW_SPAN + low


def between(drawn: Column, low: int, high: int) -> Column:
    """Uniform integer in ``low .. high``, both ends included."""
    return drawn % F.lit(high - low + 1) + F.lit(low)


def pick(drawn: Column, values: list) -> Column:
    """One of ``values`` with equal chance; a value may be None."""
    return F.array(*[F.lit(v) for v in values])[(drawn % len(values)).cast("int")]
