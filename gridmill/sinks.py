"""Sinks. Every path may be any Hadoop URI; a target is replaced and its folder is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.calendar import month_label, month_number
from gridmill.operators.monthly import monthly_table
from gridmill.sources.scratch import delete_folder, scratch_path


def _by_year(wide: DataFrame) -> DataFrame:
    """Twelve rows per year at most, so one task per year makes one file per year."""
    table = monthly_table(wide)
    return table.repartition("year").sortWithinPartitions("year", month_number(F.col("Month")))


_FORMS = {"folders": "year=*", "year files": "[0-9+-]*.csv"}


def refuse_mixed(spark: SparkSession, path: str, but: str | None = None) -> None:
    """Raise if ``path`` holds monthly tables as folders and as plain files, or in another form than
    ``but``: a year could be there in both, of different runs."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [form for form, pattern in _FORMS.items() if files.globStatus(jvm_path(path, pattern))]
    if len(found) > 1 or (but is not None and found and found != [but]):
        raise ValueError(f"{path} holds monthly tables as {' and as '.join(found)}; use a folder for each form")


def write_monthly(wide: DataFrame, path: str) -> None:
    """``path/year=YYYY/*.csv`` with header ``Month,<variables>``. Years that are written again
    replace their folder; other years stay, as earlier runs left them. A folder with tables in
    the other form is refused."""
    refuse_mixed(wide.sparkSession, path, "folders")
    (
        _by_year(wide)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("year")
        .csv(path)
    )


def write_monthly_long(monthly: DataFrame, path: str) -> None:
    """``path/year=YYYY/*.csv`` with header ``Month,name,value``, for any number of variables.
    A year takes as many files as adaptive execution finds useful."""
    (
        monthly.select("year", month_label(F.col("month")).alias("Month"), "name", "value", "month")
        .repartition("year", "name")
        .sortWithinPartitions("year", "name", "month")
        .drop("month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("year")
        .csv(path)
    )


def write_year_files(wide: DataFrame, path: str) -> None:
    """The same tables as ``path/YYYY.csv``, one plain file per year; others in the folder stay.

    One distributed write into a staging folder beside the target, then one rename per year.
    Nothing in the target changes before all parts are known to be one per year.
    """
    spark = wide.sparkSession
    refuse_mixed(spark, path, "year files")
    if wide.where(F.col("year").isNull()).head(1):
        raise ValueError("a table without a year has no file name")
    staging = f"{path.rstrip('/')}/_staging_{scratch_path(spark).rsplit('-', 1)[-1]}"
    try:
        # No limit of rows from the session: a year is one file.
        (
            _by_year(wide)
            .write.option("header", True)
            .option("maxRecordsPerFile", 0)
            .partitionBy("year")
            .csv(staging)
        )
        _move_years(spark, staging, path)
    finally:
        delete_folder(spark, staging)


def _move_years(spark: SparkSession, staging: str, path: str) -> None:
    """Put the staged years into place. A year's former file is set aside, and goes with the staging
    folder when all are moved; if a step fails, it comes back."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [p.getPath() for p in files.globStatus(jvm_path(staging, "year=*/part-*"))]
    years = [p.getParent().getName().removeprefix("year=") for p in parts]
    if len(set(years)) < len(years):
        raise OSError(f"a year has more than one part in {staging}")
    moved = []
    try:
        for year, part in zip(years, parts):
            target, aside = jvm_path(path, f"{year}.csv"), jvm_path(staging, f"former-{year}")
            former = files.exists(target)
            if former and not files.rename(target, aside):
                raise OSError(f"could not set {target} aside")
            moved.append((target, aside if former else None))
            if not files.rename(part, target):
                raise OSError(f"could not move {part} to {target}")
    except BaseException:
        for target, aside in reversed(moved):
            files.delete(target, False)
            if aside is not None:
                files.rename(aside, target)
        raise


def write_summary(yearly: DataFrame, path: str) -> None:
    """The yearly summary as one CSV file sorted by year. It has one row per year, so a single
    task can hold it whatever the size of the input."""
    year = "year" if "year" in yearly.columns else "Year"
    single = yearly.repartition(1).sortWithinPartitions(year)
    single.write.mode("overwrite").option("header", True).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    """Any table as CSV files."""
    table.write.mode("overwrite").option("header", True).csv(path)


def write_long(table: DataFrame, path: str, key: str) -> None:
    """A long table as CSV files, sorted by ``key`` and cut into ranges of it."""
    (
        table.repartitionByRange(key)
        .sortWithinPartitions(key, "year")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_series(series: DataFrame, path: str) -> None:
    """One folder per variable, with ``year,stat,value`` sorted by year."""
    (
        series.repartition("variable")
        .sortWithinPartitions("variable", "year", F.col("stat"))
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy("variable")
        .csv(path)
    )
