"""Money arithmetic on columns: row amounts, exact averages, published doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "exact"
FLOAT = "float"
AMOUNT = "decimal(28,2)"


def exact_amount(quantity: str, unit_price: str, discount_pct: str) -> Column:
    """Discounted amount as ``decimal(28,2)``, rounded half up once, at the end.

    Price and discount are taken with the digits they print with, so a float's
    width does not show. Up to seven decimals and prices below 1e9 the product is
    exact in decimal arithmetic; any other finite value is priced in double
    arithmetic instead. Null if an input is null, and for what no such decimal can
    hold (NaN, infinities, 1e26 and more); :func:`unpriceable` tells the two apart.
    """
    digits = [F.col(c).cast("string") for c in (unit_price, discount_pct)]
    price, discount = digits[0].try_cast("decimal(16,7)"), digits[1].try_cast("decimal(10,7)")
    # decimal(10,0) * decimal(16,7) * decimal(10,7) has 38 digits, 14 of them decimals: none is cut
    kept = (F.lit(100) - discount).try_cast("decimal(10,7)")
    cents = F.round(F.col(quantity).cast("decimal(10,0)") * price * kept, 0)
    exact = (cents * F.expr("0.01BD")).try_cast(AMOUNT)
    as_read = [d.try_cast("double") for d in digits]
    other = F.round(F.col(quantity) * as_read[0] * (F.lit(100) - as_read[1]) / F.lit(100), 2)
    whole = F.lit(True)
    for text, cut in zip(digits, (price, discount)):
        whole = whole & F.coalesce(text.try_cast("decimal(38,18)") == cut, F.lit(False))
    return F.when(whole, exact).otherwise(other.try_cast(AMOUNT))


def unpriceable(amount: str, *inputs: str) -> Column:
    """Whether all inputs are there but the amount is not a number of cents."""
    there = F.lit(True)
    for name in inputs:
        there = there & F.col(name).isNotNull()
    return there & in_cents(amount).isNull()


def in_cents(amount: str) -> Column:
    """An amount rounded to cents as exact decimal, so that sums do not depend on their order."""
    return F.col(amount).try_cast(AMOUNT)


def float_amount(quantity: str, unit_price: str, discount_pct: str) -> Column:
    """Discounted amount in binary floating point, rounded to cents.

    The gross amount is a 32-bit product whatever ``spark.sql.ansi.enabled``
    says (ANSI typing would widen ``int * float`` to double and move cents);
    the discount factor and the result are doubles.
    """
    gross = F.col(quantity).cast("float") * F.col(unit_price)
    kept_share = F.lit(1) - F.col(discount_pct) / F.lit(100)
    return F.round(gross * kept_share, 2)


def rounded_average(total: Column, count: Column) -> Column:
    """``total / count`` to the cent, half away from zero, as double.

    ``total`` is an exact decimal with two places, so the average is taken on
    whole cents with integer division and no intermediate rounding. Null when
    ``count`` is 0.
    """
    cents = (F.abs(total) * F.lit(100)).cast("decimal(37,0)")
    twice = F.nullif(count * F.lit(2), F.lit(0)).cast("decimal(20,0)")
    whole = F.call_function("div", cents * F.lit(2) + count, twice)
    return F.signum(total) * whole / F.lit(100.0)


def published(amount: Column, unpriceable: Column) -> Column:
    """An amount sum as the double the marts publish; NaN if a row in it could not be priced."""
    return F.when(unpriceable > 0, F.lit(float("nan"))).otherwise(F.round(amount, 2).cast("double"))
