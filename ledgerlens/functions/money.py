"""Exact money: decimal parsing, cents, half-up percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"
WHOLE = "decimal(38,0)"


def cents(value: Column) -> Column:
    """Round to cents, halves away from zero."""
    return F.round(value, 2).cast(CENTS)


def parse_decimal(text: Column) -> Column:
    """A finite decimal number written as text, else NULL (blank, NaN, Infinity and words are NULL)."""
    trimmed = F.trim(text)
    finite = trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(finite, trimmed.try_cast("decimal(38,6)"))


#: Whole digits of an amount beyond which it does not fit ``decimal(38,2)``.
WHOLE_DIGITS = 36


def parse_cents(text: Column) -> Column:
    """A finite decimal number written as text, of any number of decimals and with any exponent, rounded once to cents.

    Halves go away from zero. The digits of the text decide: those up to the second decimal place are kept, and the
    one after them rounds; no fixed scale comes between. What is no number, or has more than ``WHOLE_DIGITS`` whole
    digits, is NULL.
    """
    trimmed = F.trim(text)
    piece = lambda group: F.regexp_extract(trimmed, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z", group)
    number = trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    digits = F.ltrim(F.concat(piece(2), piece(3)), F.lit("0"))
    # Places before the point, without the zeros in front; an exponent beyond these bounds decides alone.
    exponent = F.when(piece(4) == "", F.lit("0")).otherwise(piece(4)).try_cast("bigint")
    exponent = F.coalesce(exponent, F.when(F.startswith(piece(4), F.lit("-")), F.lit(-(1 << 40))).otherwise(F.lit(1 << 40)))
    exponent = F.greatest(F.least(exponent, F.lit(1 << 40)), F.lit(-(1 << 40)))
    point = F.length(digits) - F.length(piece(3)) + exponent
    fits = (point <= WHOLE_DIGITS) | (digits == "")
    kept = F.greatest(F.least(point + 2, F.lit(WHOLE_DIGITS + 2)), F.lit(0)).cast("int")
    whole = F.rpad(F.substr(digits, F.lit(1), kept), kept, F.lit("0"))
    up = (point + 2 >= 0) & (F.substr(digits, kept + 1, F.lit(1)) >= "5")
    total = F.concat(F.lit("0"), whole).cast(WHOLE) + F.when(up, 1).otherwise(0).cast(WHOLE)
    hundredth = F.when(piece(1) == "-", F.lit("-0.01").cast("decimal(3,2)")).otherwise(F.lit("0.01").cast("decimal(3,2)"))
    return F.when(number & fits, (total * hundredth).cast("decimal(38,2)"))


def percent_of(delta: Column, base: Column) -> Column:
    """``delta * 100 / base`` rounded once to two places, halves away from zero; NULL for a zero base.

    Works on whole cents, because the scale of a decimal quotient is limited and would round twice.
    """
    d = (F.abs(delta) * 100).cast(WHOLE)
    b = (F.abs(base) * 100).cast(WHOLE)
    numerator = d * F.lit(20000).cast("decimal(10,0)") + b
    hundredths = F.call_function("div", numerator, b * F.lit(2).cast("decimal(10,0)"))
    signed = (F.signum(delta) * F.signum(base)).cast("long") * hundredths
    return F.when(base != 0, (signed.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast(CENTS))


def variance(value: Column, baseline: Column) -> tuple[Column, Column]:
    """Amount and percent of a value against its baseline."""
    delta = value - baseline
    return cents(delta), percent_of(delta, baseline)
