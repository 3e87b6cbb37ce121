"""Monthly means, long (``year, month, name, value``) and wide (one column per variable)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.calendar import month_label
from gridmill.functions.quoting import named


def monthly_mean(messages: DataFrame, keys: Sequence[str] = ("year", "month", "name")) -> DataFrame:
    """Mean of the message means: every message has weight 1, whatever the size of its grid."""
    return messages.groupBy(*keys).agg(F.avg("grid_mean").alias("value"))


def monthly_mean_wide(table: DataFrame, time: str, variables: Sequence[str]) -> DataFrame:
    """The same for a table that already has one column per variable."""
    return table.groupBy(F.year(time).alias("year"), F.month(time).alias("month")).agg(
        *[F.avg(named(variable)).alias(variable) for variable in variables]
    )


def monthly_wide(monthly: DataFrame, names: Sequence[str]) -> DataFrame:
    """Variables become columns, in the order of ``names``. The list is given, so no job runs to
    find it."""
    if not names:
        return monthly.select("year", "month").distinct()
    wide = monthly.groupBy("year", "month").pivot("name", list(names)).agg(F.first("value"))
    return wide.select("year", "month", *[named(name) for name in names])


def monthly_table(wide: DataFrame) -> DataFrame:
    """``year, Month, <variables>``: month labels instead of numbers, as the written tables show.

    Column names do not tell cases apart, so the label takes the place of the number.
    """
    variables = [named(c) for c in wide.columns if c not in ("year", "month")]
    return wide.select("year", month_label(F.col("month")).alias("Month"), *variables)


def dense_months(
    monthly: DataFrame,
    names: Sequence[str] | None = None,
    empty: float | None = None,
    years: DataFrame | None = None,
) -> DataFrame:
    """All twelve months of each year and variable; a month without messages gets ``empty``
    (null, or NaN on request).

    The variables are ``names`` for every year, or those that each year has; with ``names`` the
    years may be given too (distinct ``year`` rows), to show those without any month. The spine
    grows with years and variables only. ``monthly`` is read twice: pass it materialized.
    """
    if names is None:
        spine = monthly.select("year", "name").distinct()
    else:
        labels = F.array(*[F.lit(name) for name in names]).cast("array<string>")
        years = monthly.select("year").distinct() if years is None else years.select("year")
        spine = years.withColumn("name", F.explode(labels))
    spine = spine.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    dense = spine.join(
        monthly.select("year", "month", "name", "value", F.lit(True).alias("_found")),
        ["year", "month", "name"],
        "left",
    )
    value = F.when(F.col("_found"), F.col("value")).otherwise(F.lit(empty).cast("double"))
    return dense.select("year", "month", "name", value.alias("value"))


def keep_last_per_year(table: DataFrame) -> DataFrame:
    """Of several files of one year, keep the rows of the last by name."""
    last = table.groupBy("year").agg(F.max("file").alias("file"))
    return table.join(last, ["year", "file"], "left_semi")


def keep_last_files(facts: DataFrame) -> DataFrame:
    """The same on file facts, before any message is aggregated: one row per year is left."""
    others = [c for c in facts.columns if c not in ("year", "file")]
    last = facts.groupBy("year").agg(F.max(F.struct("file", *others)).alias("_last"))
    return last.select("year", "_last.*")


def replaced_files(facts: DataFrame) -> DataFrame:
    """``file, year, messages, replaced_by``: the files that ``keep_last_files`` leaves out of
    facts ``file, year, num``."""
    last = facts.groupBy("year").agg(F.max("file").alias("replaced_by"))
    return (
        facts.join(last, "year")
        .where("file <> replaced_by")
        .select("file", "year", F.col("num").alias("messages"), "replaced_by")
    )


def first_file_names(table: DataFrame) -> DataFrame:
    """``var_ix, name`` of the first file by name."""
    first = table.agg(F.min("file").alias("file"))
    return table.join(first, "file", "left_semi").select("var_ix", "name").distinct()


def first_file_schema(monthly: DataFrame, names: DataFrame) -> DataFrame:
    """Project every year to the variables of the first file, with their ``var_ix``."""
    kept = monthly.drop("var_ix") if "var_ix" in monthly.columns else monthly
    return kept.join(names, "name")
