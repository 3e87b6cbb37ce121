"""Choice of variables, and the trend series that charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.naming import STATS, stat_columns, year_column
from gridmill.functions.quoting import named


def select_variables(table: DataFrame, chosen: Sequence[str], column: str = "name") -> DataFrame:
    """Rows of the chosen variables; an empty choice gives an empty table."""
    return table.where(F.col(column).isin(list(chosen)))


def select_summary(
    yearly: DataFrame, chosen: Sequence[str], naming: str = "prefix"
) -> tuple[DataFrame, list[str]]:
    """(summary of the chosen variables, those that lack one of their three columns)."""
    present, lacking = [], []
    for variable in chosen:
        whole = set(stat_columns([variable], naming)) <= set(yearly.columns)
        (present if whole else lacking).append(variable)
    order = [year_column(naming), *stat_columns(present, naming)]
    return yearly.select(*[named(column) for column in order]), lacking


def missing_variables(spark: SparkSession, chosen: Sequence[str], table: DataFrame) -> DataFrame:
    """The chosen variables that a long table does not hold."""
    wanted = spark.createDataFrame([(name,) for name in chosen], "name string")
    return wanted.join(table.select("name").distinct(), "name", "left_anti")


def trend_series(
    yearly: DataFrame, variables: Sequence[str], naming: str = "prefix"
) -> DataFrame:
    """``variable, year, stat, value``: three lines over the years for each variable."""
    columns = stat_columns(variables, naming)
    year = year_column(naming)
    shape = "variable string, year int, stat string, value double"
    if not columns:
        return yearly.sparkSession.createDataFrame([], shape)
    series = yearly.unpivot(named(year), [named(c) for c in columns], "_column", "value")
    column, width = F.col("_column"), len(STATS[0])
    if naming == "prefix":
        stat, variable = F.substring(column, 1, width), F.expr(f"substring(_column, {width + 2})")
    else:
        stat = F.substring(column, -width, width)
        variable = F.expr(f"left(_column, length(_column) - {width + 1})")
    return series.select(
        variable.alias("variable"), F.col(year).alias("year"), stat.alias("stat"), "value"
    )


def trend_series_long(yearly: DataFrame) -> DataFrame:
    """The same from long yearly statistics (``year, name, min, max, avg``)."""
    series = yearly.unpivot(["name", "year"], list(STATS), "stat", "value")
    return series.select(F.col("name").alias("variable"), "year", "stat", "value")


def series_span(series: DataFrame) -> DataFrame:
    """First and last year of each variable, for the title of its chart."""
    return series.groupBy("variable").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
