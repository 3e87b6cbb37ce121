"""Monthly and summary tables: CSV scans, and the union of tables that differ in columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.calendar import month_number
from gridmill.functions.filenames import year_from_file_name
from gridmill.functions.naming import stat_columns, year_column

# How the text of the tables spells not-a-number, and their first column.
NAN_TEXT = "nan"
MONTH_COLUMN = "Month"


def _doubles(first: T.StructField, names: Iterable[str]) -> T.StructType:
    return T.StructType([first, *[T.StructField(name, T.DoubleType()) for name in names]])


def scan_monthly_csv(
    spark: SparkSession,
    path: str,
    variables: Sequence[str],
    glob: str = "*.csv",
    exclude_prefix: str | None = None,
) -> DataFrame:
    """``Month, <variables>, year`` from files named ``YYYY.csv`` that share one header.

    The schema is given, so ``nan`` is a double and nothing is inferred in an extra pass. A
    file whose header differs raises: by-position reading would put its values into the wrong
    columns. Use ``scan_monthly_cells`` for such folders. Files without a year in their name
    get a null year.
    """
    month = T.StructField(MONTH_COLUMN, T.StringType())
    table = (
        spark.read.schema(_doubles(month, variables))
        .option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", NAN_TEXT)
        .option("pathGlobFilter", glob)
        .csv(path)
    )
    file_name = F.col("_metadata.file_name")
    if exclude_prefix is not None:
        table = table.where(~file_name.startswith(exclude_prefix))
    return table.withColumn("year", year_from_file_name(file_name))


# A cell of a CSV line: quoted, with quotes inside doubled or after a backslash, or up to the next
# comma.
_CELL = r'(?:^|(?<=,))(?:"(?:[^"\\]|""|\\.)*+"|[^,]*+)'


def _line_cells(line: Column) -> Column:
    """The cells of a line. Only lines with quotes need a pattern."""
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(_CELL), F.lit(0)),
        lambda cell: F.when(
            cell.startswith('"'), F.regexp_replace(F.regexp_replace(cell, '^"|"$', ""), r'["\\](["\\])', "$1")
        ).otherwise(cell),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def monthly_cells(
    spark: SparkSession,
    path: str,
    glob: str = "*.csv",
    exclude_prefix: str | None = None,
) -> DataFrame:
    """``file, year, month, name, value, error`` from monthly CSV files whose headers may differ in
    names and order: each cell is labelled by the header of its own file.

    A monthly file holds a header and twelve lines, so it is read whole, one row a file. Folders
    below are read too. The year
    is that of the file's name, or of a ``year=`` folder above it, as ``write_monthly`` makes them.
    ``error`` is set for a file without a year (one row, nothing else), text that is neither empty
    nor a number, and cells beyond the header. A label that is no English month gives a null
    month. An empty folder gives an empty table.
    """
    texts = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.coalesce(
                year_from_file_name(F.col("_metadata.file_name")),
                F.regexp_extract("_metadata.file_path", r"/year=([0-9]+)/[^/]*$", 1).try_cast("int"),
            ).alias("year"),
            F.filter(F.split("value", "\r?\n"), lambda line: line != "").alias("lines"),
        )
    )
    if exclude_prefix is not None:
        texts = texts.where(~F.col("file").startswith(exclude_prefix))

    no_year = texts.where(F.col("year").isNull()).select(
        "file", "year",
        F.lit(None).cast("int").alias("month"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("double").alias("value"), F.lit("no year in its name").alias("error"),
    )
    header = _line_cells(F.get("lines", F.lit(0)))
    lines = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    rows = (
        texts.where(F.col("year").isNotNull())
        .select("file", "year", header.alias("header"), lines.alias("lines"))
        .select("file", "year", "header", F.explode("lines").alias("line"))
        .select("file", "year", "header", _line_cells(F.col("line")).alias("row"))
    )
    # The longer of both: a cell without a name is an error, a name without a cell is empty.
    cells = F.arrays_zip("header", "row")
    cells = F.explode(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))))
    label, name, text = F.get("row", F.lit(0)), F.col("cell.header"), F.trim("cell.row")
    parsed = rows.select("file", "year", label.alias("label"), cells.alias("cell")).select(
        "file",
        "year",
        month_number(F.col("label")).alias("month"),
        name.alias("name"),
        F.col("cell.row").try_cast("double").alias("value"),
        text.alias("_text"),
    )
    filled = F.coalesce(F.col("_text"), F.lit("")) != ""
    error = (
        F.when(F.col("name").isNull() & filled, F.concat(F.lit("cell beyond the header: "), "_text"))
        .when(filled & F.col("value").isNull(), F.concat(F.lit("not a number: "), "_text"))
    )
    found = parsed.withColumn("error", error).drop("_text")
    return found.where(F.col("name").isNotNull() | F.col("error").isNotNull()).unionByName(no_year)


def scan_monthly_cells(
    spark: SparkSession,
    path: str,
    glob: str = "*.csv",
    exclude_prefix: str | None = None,
) -> DataFrame:
    """``file, year, month, name, value``: ``monthly_cells`` without those that have an error."""
    cells = monthly_cells(spark, path, glob, exclude_prefix)
    return cells.where(F.col("error").isNull()).drop("error")


def scan_monthly_partitions(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """Read back what ``write_monthly`` wrote: ``Month, <variables>, year`` with ``year`` from
    the folder names, so a filter on it prunes folders."""
    schema = _doubles(T.StructField(MONTH_COLUMN, T.StringType()), variables).add("year", T.IntegerType())
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", NAN_TEXT)
        .csv(path)
    )


def read_summary(
    spark: SparkSession, path: str, variables: Sequence[str], naming: str = "prefix"
) -> DataFrame:
    """The yearly summary as a typed table."""
    year = T.StructField(year_column(naming), T.IntegerType())
    return (
        spark.read.schema(_doubles(year, stat_columns(variables, naming)))
        .option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", NAN_TEXT)
        .csv(path)
    )


def union_years(tables: Iterable[DataFrame]) -> DataFrame:
    """Stack yearly tables by column name, those of the first tables first; a column that one of
    them lacks is null there.

    Pairs are united, then pairs of pairs: the plan of a thousand tables is ten unions deep and not
    a thousand, which the analyzer would walk through again for each table.
    """
    held = list(tables)
    if not held:
        raise ValueError("no table to stack")
    while len(held) > 1:
        pairs = [held[i : i + 2] for i in range(0, len(held), 2)]
        held = [p[0].unionByName(p[1], allowMissingColumns=True) if len(p) == 2 else p[0] for p in pairs]
    return held[0]

