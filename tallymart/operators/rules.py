"""Declarative data-quality rules: one list drives both cleaning and reporting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import cleaning

NULL_OUT = "null_out"
DROP_ROW = "drop_row"
STANDARDISE = "standardise"


@dataclass(frozen=True)
class Rule:
    """What is wrong with a value of ``column`` and what to do about it.

    ``expression`` is Spark SQL over the row as it arrived. For ``null_out``
    and ``drop_row`` it is the violation; for ``standardise`` it is the new
    value, and a violation is a value the rule changes.
    """

    name: str
    column: str
    action: str
    expression: str

    def violated(self) -> Column:
        """True or false, never null."""
        if self.action == STANDARDISE:
            return ~F.col(self.column).eqNullSafe(F.expr(self.expression))
        return F.coalesce(F.expr(self.expression), F.lit(False))

    def cleaned(self) -> Column:
        """The value to keep; only for rules that change a value."""
        if self.action == STANDARDISE:
            return F.expr(self.expression)
        return F.when(~self.violated(), F.col(self.column))


# The accepted ranges, words and codes of the sales feed.
MIN_AGE, MAX_AGE = 15, 100
MIN_DISCOUNT, MAX_DISCOUNT = 0, 100
GENDER_WORDS = {"MALE": "M", "FEMALE": "F"}
GENDER_CODES = ["M", "F"]
PAYMENT_TYPES = ["Card", "UPI", "COD"]

SALES_RULES = (
    Rule("ship_date", "ship_date", NULL_OUT, cleaning.below("ship_date", "order_date")),
    Rule("quantity", "quantity", DROP_ROW, cleaning.not_above("quantity", "0")),
    Rule("unit_price", "unit_price", NULL_OUT, cleaning.at_most("unit_price", "0")),
    Rule(
        "discount",
        "discount_pct",
        NULL_OUT,
        cleaning.outside("discount_pct", str(MIN_DISCOUNT), str(MAX_DISCOUNT)),
    ),
    Rule(
        "customer_age",
        "customer_age",
        NULL_OUT,
        cleaning.outside("customer_age", str(MIN_AGE), str(MAX_AGE)),
    ),
    Rule(
        "gender",
        "gender",
        STANDARDISE,
        cleaning.standardised("gender", GENDER_WORDS, GENDER_CODES),
    ),
    Rule(
        "payment_type",
        "payment_type",
        NULL_OUT,
        cleaning.not_among("payment_type", PAYMENT_TYPES),
    ),
)


def rule(name: str, rules: Sequence[Rule] = SALES_RULES) -> Rule:
    """The rule of that name."""
    return next(r for r in rules if r.name == name)


def dropped_by(rules: Sequence[Rule]) -> Column:
    """Whether any of the rules drops the row; true or false, never null."""
    drops = [r.violated() for r in rules if r.action == DROP_ROW]
    return reduce(or_, drops, F.lit(False))


def apply_rules(df: DataFrame, rules: Sequence[Rule] = SALES_RULES) -> DataFrame:
    """Drop the rows and change the values the rules name, in one narrow step.

    Every rule sees the row as it arrived. No rule reads a column another one
    changes, so this equals applying them one after the other.
    """
    columns = [r.column for r in rules if r.action != DROP_ROW]
    if len(columns) != len(set(columns)):
        raise ValueError(f"more than one rule changes the same column: {columns}")
    if any(r.action == DROP_ROW for r in rules):
        df = df.where(~dropped_by(rules))
    cleaned = {r.column: r.cleaned() for r in rules if r.action != DROP_ROW}
    return df.withColumns(cleaned) if cleaned else df


_RULES_A_MASK = 31


def _findings(rules: Sequence[Rule]) -> Column:
    """Two bits for each rule in order: whether the row violates it, and has no value for it."""
    bits = F.lit(0).cast("bigint")
    for at, r in enumerate(rules):
        bits += r.violated().cast("bigint") * (1 << 2 * at)
        bits += F.col(r.column).isNull().cast("bigint") * (2 << 2 * at)
    return bits


def dq_report(df: DataFrame, key: str, rules: Sequence[Rule] = SALES_RULES) -> DataFrame:
    """Per rule: rows checked, rows violating it, rows with no value to check.

    One pass over ``df``: rows are counted by key, and by what all rules find in them, in
    one aggregate with one counter that combines per map task before the shuffle. A key
    or null that holds most rows sends one row for each task; the findings are few.
    """
    parts = [rules[at : at + _RULES_A_MASK] for at in range(0, len(rules), _RULES_A_MASK)]
    masks = [f"_findings_{at}" for at in range(len(parts))]
    found = df.select(key, *[_findings(part).alias(mask) for mask, part in zip(masks, parts)])
    counted = found.groupingSets([[key], masks], key, *masks).agg(
        F.count(F.lit(1)).alias("_rows"), F.grouping(key).alias("_by_findings")
    )

    by_key = F.col("_by_findings") == 0

    def rows(condition, number=F.col("_rows")):
        return F.coalesce(F.sum(F.when(condition, number)), F.lit(0)).cast("bigint")

    def line(name, column, action, violating, nulls):
        return F.struct(
            F.lit(name).alias("rule"),
            F.lit(column).alias("column_name"),
            F.lit(action).alias("action"),
            rows(by_key).alias("rows_checked"),
            violating.alias("rows_violating"),
            nulls.alias("rows_null"),
        )

    more, no_key = rows(by_key, F.col("_rows") - 1), rows(by_key & F.col(key).isNull())
    lines = [line("duplicate_key", key, DROP_ROW, more, no_key)]
    for mask, part in zip(masks, parts):
        for at, r in enumerate(part):
            bit = [~by_key & (F.col(mask).bitwiseAND(b << 2 * at) != 0) for b in (1, 2)]
            lines.append(line(r.name, r.column, r.action, rows(bit[0]), rows(bit[1])))
    return counted.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
