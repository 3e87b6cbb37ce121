"""Facts carried by file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def year_from_file_name(path: Column) -> Column:
    """The base name up to its first dot as an int; null if that is not a whole number."""
    return F.regexp_extract(base_name(path), r"^\s*([+-]?\d+)\s*(\.|$)", 1).try_cast("int")
