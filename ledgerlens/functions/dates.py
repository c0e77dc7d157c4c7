"""Strict ISO dates and inclusive windows; the as-of date is always an argument."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_literal(as_of: str | date) -> Column:
    return F.lit(date.fromisoformat(str(as_of)))


def parse_iso_date(text: Column) -> Column:
    """A calendar date written YYYY-MM-DD, else NULL."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def days_until(end: Column, as_of: str | date) -> Column:
    return F.datediff(end, as_of_literal(as_of))


def within_days(end: Column, as_of: str | date, days: int) -> Column:
    if isinstance(days, bool) or not isinstance(days, int) or not 0 <= days <= 3650:
        raise ValueError("days must be between 0 and 3650")
    first = date.fromisoformat(str(as_of))
    # A plain range on the date column, so that it reaches the scan.
    return end.between(F.lit(first), F.lit(first + timedelta(days=days)))
