"""Yearly minimum, maximum and average over the monthly means (each month has weight 1)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.measures import apply_nan_policy
from gridmill.functions.naming import STATS, stat_column, stat_columns, year_column
from gridmill.functions.quoting import named, quoted

_AGGREGATES = {"min": F.min, "max": F.max, "avg": F.avg}
_LABELS = ("month", "Month", "year")


def variable_columns(monthly: DataFrame) -> list[str]:
    """The variables of a wide monthly table, told by name and not by position."""
    return [column for column in monthly.columns if column not in _LABELS]


def valid_years(table: DataFrame) -> DataFrame:
    return table.where(F.col("year").isNotNull())


def distinct_years(table: DataFrame) -> DataFrame:
    return table.select("year").distinct().orderBy("year")


def yearly_stats(
    monthly: DataFrame,
    variables: Sequence[str] | None = None,
    nan_policy: str = "skip",
    naming: str = "prefix",
) -> DataFrame:
    """One row per year; for each variable min, max and avg side by side.

    ``naming="prefix"`` gives ``year, min_<v>, max_<v>, avg_<v>``; ``"suffix"`` gives
    ``Year, <v>_min, <v>_max, <v>_avg``.
    """
    names = variable_columns(monthly) if variables is None else list(variables)
    aggregates = [
        _AGGREGATES[stat](apply_nan_policy(named(v), nan_policy)).alias(stat_column(stat, v, naming))
        for v in names
        for stat in STATS
    ]
    year = F.col("year").alias(year_column(naming))
    if not aggregates:
        return monthly.select(year).distinct()
    return monthly.groupBy(year).agg(*aggregates)


def yearly_long(monthly: DataFrame, nan_policy: str = "skip") -> DataFrame:
    """``year, name, min, max, avg``: the plan stays the same however many variables there are."""
    value = apply_nan_policy(F.col("value"), nan_policy)
    return monthly.groupBy("year", "name").agg(*[_AGGREGATES[s](value).alias(s) for s in STATS])


def yearly_wide(yearly: DataFrame, names: Sequence[str], naming: str = "prefix") -> DataFrame:
    """Long yearly statistics as the wide summary table."""
    if not names:
        return yearly.select(F.col("year").alias(year_column(naming))).distinct()
    pivoted = yearly.groupBy("year").pivot("name", list(names)).agg(
        *[F.first(stat).alias(stat) for stat in STATS]
    )
    columns = [
        named(f"{name}_{stat}").alias(stat_column(stat, name, naming))
        for name in names
        for stat in STATS
    ]
    return pivoted.select(F.col("year").alias(year_column(naming)), *columns)


def interleave_stats(
    yearly: DataFrame, variables: Sequence[str], naming: str = "prefix"
) -> DataFrame:
    """Put the columns of a summary in the order year, then min, max, avg of each variable."""
    order = [year_column(naming), *stat_columns(variables, naming)]
    return yearly.select(*[named(column) for column in order])


def sort_years(yearly: DataFrame) -> DataFrame:
    """Sort by year as a number; the last step, as a later join need not keep an order."""
    return yearly.orderBy(quoted("year" if "year" in yearly.columns else "Year"))


def year_spine(spark: SparkSession, years: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(year),) for year in years], "year int")


def year_spine_join(yearly: DataFrame, spine: DataFrame, naming: str = "prefix") -> DataFrame:
    """All years of the spine; one without data shows nulls."""
    year = year_column(naming)
    return spine.select(F.col("year").alias(year)).join(yearly, year, "left")
