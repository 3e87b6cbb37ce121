"""Fields of a message description.

A description is colon-separated text. The second field is the variable name; the last
field ends in a twelve-digit stamp ``yyyyMMddHHmm``. Text that does not hold a field gives
null instead of an error, so one odd message does not end a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator and stamp layout of a message description.
SEPARATOR = ":"
STAMP_LENGTH = 12


def _stamp_part(description: Column, offset: int, length: int) -> Column:
    last_field = F.substring_index(description, SEPARATOR, -1)
    return F.substring(last_field, offset - STAMP_LENGTH, length).try_cast("int")


def variable_name(description: Column) -> Column:
    return F.get(F.split(description, SEPARATOR), F.lit(1))


def stamp_year(description: Column) -> Column:
    return _stamp_part(description, 0, 4)


def valid_time(description: Column) -> Column:
    """Zone-free time of the message; no session time zone can shift it."""
    return F.try_make_timestamp_ntz(
        years=stamp_year(description),
        months=_stamp_part(description, 4, 2),
        days=_stamp_part(description, 6, 2),
        hours=_stamp_part(description, 8, 2),
        mins=_stamp_part(description, 10, 2),
        secs=F.lit(0).cast("decimal(16,6)"),
    )
