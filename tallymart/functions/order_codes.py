"""Several columns as one number that sorts as they do."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type to its smallest value, the bits of its range, and how it becomes a number.
_WHOLE = {
    "boolean": (0, 1, lambda c: c.cast("int")),
    "tinyint": (-(2**7), 8, lambda c: c),
    "smallint": (-(2**15), 16, lambda c: c),
    "int": (-(2**31), 32, lambda c: c),
    "date": (-(2**31), 32, F.unix_date),
    "bigint": (-(2**63), 64, lambda c: c),
    "timestamp": (-(2**63), 64, F.unix_micros),
}
_DIGITS = 38


def order_code(df: DataFrame, columns: Sequence[str]) -> Column | None:
    """A ``decimal(38,0)``, never null, that orders rows as ``columns`` do, ascending, nulls first.

    Each column is a digit of a number in mixed radix, null its zero. An aggregate can
    keep such a number in place, so the smallest is found by hashing, without a sort.
    None where a column is no whole number, date or time, or where 38 digits do not hold
    all of them (four whole ``int`` or date columns do not).
    """
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    if not all(k in _WHOLE for k in kinds):
        return None
    radix = [2 ** _WHOLE[k][1] + 1 for k in kinds]
    if prod(radix) >= 10**_DIGITS:
        return None
    code = F.lit(0).cast(f"decimal({_DIGITS},0)")
    for name, kind, size in zip(columns, kinds, radix):
        low, _, number = _WHOLE[kind]
        digit = number(F.col(name)).cast("decimal(20,0)") - F.expr(f"{low - 1}BD")
        digit = F.coalesce(digit, F.expr("0BD")).cast("decimal(20,0)")
        code = (code * F.expr(f"{size}BD") + digit).cast(f"decimal({_DIGITS},0)")
    return code
