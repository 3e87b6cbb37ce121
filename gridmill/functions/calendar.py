"""Calendar arithmetic of position mode, and month labels.

Position mode counts every fourth year as a leap year, 1900 and 2100 too. Mapping each year
to 2000 (leap) or 2001 (common) lets the built-in date functions carry that rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month labels of the monthly tables.
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _is_leap(year: Column) -> Column:
    return year % 4 == 0


def _model_year(year: Column) -> Column:
    return F.when(_is_leap(year), F.lit(2000)).otherwise(F.lit(2001))


def _model_day(year: Column, day_index: Column) -> Column:
    return F.date_add(F.make_date(_model_year(year), F.lit(1), F.lit(1)), day_index.cast("int"))


def days_per_year(year: Column) -> Column:
    return F.when(_is_leap(year), F.lit(366)).otherwise(F.lit(365))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_model_year(year), month, F.lit(1))))


def month_of_day(year: Column, day_index: Column) -> Column:
    """Month 1..12 of the 0-based day of the year."""
    return F.month(_model_day(year, day_index))


def days_before_month_of_day(year: Column, day_index: Column) -> Column:
    """Days of the year that lie before the month that holds ``day_index``."""
    return day_index - F.dayofmonth(_model_day(year, day_index)) + 1


def month_label(month: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label in MONTH_LABELS]), month - 1)


def month_number(label: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(text) for text in MONTH_LABELS]), label)
    return F.nullif(position, F.lit(0)).cast("int")
