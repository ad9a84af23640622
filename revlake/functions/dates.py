"""Calendar and rounding expressions of the leave records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_day(c: Column) -> Column:
    return F.floor(c * 2 + 0.5) / 2


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def year_start(d: Column) -> Column:
    return F.make_date(F.year(d), F.lit(1), F.lit(1))


def year_end(d: Column) -> Column:
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def accrual_fraction(d: Column) -> Column:
    share = (F.datediff(d, year_start(d)) + 1) / (F.datediff(year_end(d), year_start(d)) + 1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def valid_date(text: Column) -> Column:
    """A real calendar date written YYYY-MM-DD."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))
