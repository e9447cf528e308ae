"""The cleaning plan: deduplicate first, then apply the rules.

The order is part of the result: a transaction whose surviving copy has no
positive quantity disappears even if another copy had one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.order_codes import order_code
from tallymart.operators.dedup import dedup, with_order
from tallymart.operators.rules import (
    DROP_ROW,
    SALES_RULES,
    Rule,
    apply_rules,
    dropped_by,
)
from tallymart.schema import BUSINESS_KEY, RAW_COLUMNS

DROPPED = "_dropped"


def surviving_copies(
    bronze: DataFrame,
    order_by: Sequence[str] | None = None,
    rules: Sequence[Rule] = SALES_RULES,
) -> DataFrame:
    """One row per transaction, flagged where a rule is going to drop it.

    A row to be dropped still competes with its copies, but only with its key
    and the columns that decide: the rest is nulled before the shuffle, which
    at full size is the one large transfer of the whole pipeline.
    """
    ordered, ordering = with_order(bronze, BUSINESS_KEY, order_by)
    flagged = ordered.withColumn(DROPPED, dropped_by(rules))
    carried = {BUSINESS_KEY, DROPPED, *ordering}
    light = flagged.select(
        *[
            F.col(c) if c in carried else F.when(~F.col(DROPPED), F.col(c)).alias(c)
            for c in flagged.columns
        ]
    )
    return dedup(light, BUSINESS_KEY, ordering).select(*bronze.columns, DROPPED)


def layer_counts(
    bronze: DataFrame,
    order_by: Sequence[str] | None = None,
    rules: Sequence[Rule] = SALES_RULES,
) -> DataFrame:
    """Rows as delivered, after deduplication and after all rules, in one pass.

    Per transaction only the number of copies and the fate of the surviving one are kept,
    combined per map task before the shuffle. Where the ordering columns fit one number
    (the default's fingerprint, or see ``order_code``) this hashes; any other order sorts
    key and ordering columns in the task and behind the shuffle.
    """
    ordered, ordering = with_order(bronze, BUSINESS_KEY, order_by)
    flagged = ordered.withColumn(DROPPED, dropped_by(rules))
    # the code is never null: min_by would skip copies that have a null there
    code = order_code(flagged, ordering) if order_by else F.col(ordering[0])
    if code is None:
        first = F.min(F.struct(*ordering, DROPPED)).getField(DROPPED)
    else:
        first = F.min_by(DROPPED, code)
    per_key = flagged.groupBy(BUSINESS_KEY).agg(
        F.count(F.lit(1)).alias("copies"), first.alias(DROPPED)
    )
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("bronze_rows"),
        F.count(DROPPED).alias("deduplicated_rows"),
        F.count_if(~F.col(DROPPED)).alias("silver_rows"),
    )


def finish(survivors: DataFrame, rules: Sequence[Rule] = SALES_RULES) -> DataFrame:
    """Silver rows of ``surviving_copies``: flagged rows gone, bad values replaced."""
    kept = survivors.where(~F.col(DROPPED)).select(*RAW_COLUMNS)
    return apply_rules(kept, [r for r in rules if r.action != DROP_ROW])


def clean(
    bronze: DataFrame,
    order_by: Sequence[str] | None = None,
    rules: Sequence[Rule] = SALES_RULES,
) -> DataFrame:
    """Silver rows of a bronze table.

    Extra columns of ``bronze`` may take part in ``order_by`` and are then
    gone; see ``with_order`` for its default.
    """
    return finish(surviving_copies(bronze, order_by, rules), rules)
