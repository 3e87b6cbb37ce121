"""Operators on the message table: file facts, variable discovery, position mode.

A message row holds ``file, msg_no, name, year, valid_time, grid_mean`` (``msg_no`` counts from
0 in file order). One file may hold a large part of all messages, so no operator gathers a file
in one task: facts come from partial aggregates, and position, month and variable are arithmetic
on ``msg_no``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.calendar import days_before_month_of_day, days_per_year, month_of_day
from gridmill.operators.numbering import number_rows
from gridmill.sources.scratch import materialize


def number_messages(messages: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``msg_no``, the 0-based rank within ``file`` by ``order_by`` (a unique key of it).

    For tables that hold messages without a number; decoded files bring theirs.
    """
    return number_rows(messages, "file", order_by, "msg_no")


#: Ranges up to which their counts go along with each task.
SMALL_RANGES = 500_000


def number_by_range(messages: DataFrame) -> DataFrame:
    """``msg_no`` as the 0-based number in the file, ``offset`` for the place, of messages that were
    decoded by range.

    The decoder has numbered the messages of each range, so the counts of the ranges before give
    the rest: a small table with one row for each range. Messages are neither sorted nor moved.
    Pass them materialized: the counts must be those of the same rows.
    """
    counts = messages.groupBy("file", "range_start").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(
        counts.select("file", "range_start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before")),
        "range_counts",
    )
    small = before.count() <= SMALL_RANGES
    return (
        messages.withColumnRenamed("msg_no", "offset")
        .join(F.broadcast(before) if small else before, ["file", "range_start"])
        .withColumn("msg_no", F.col("_before") + F.col("range_no"))
        .drop("range_start", "range_no", "_before")
    )


def file_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file").agg(F.count("*").alias("num"))


def file_year(messages: DataFrame) -> DataFrame:
    """The year of a file is the year of its first message."""
    return messages.groupBy("file").agg(F.min_by("year", "msg_no").alias("year"))


def file_facts(messages: DataFrame) -> DataFrame:
    """One row per file: ``num``, ``year`` and ``first_mean`` of its first message."""
    return messages.groupBy("file").agg(
        F.count("*").alias("num"),
        F.min_by("year", "msg_no").alias("year"),
        F.min_by("grid_mean", "msg_no").alias("first_mean"),
    )


def messages_per_day(facts: DataFrame) -> DataFrame:
    """Add ``days`` and ``per_day`` (whole messages per day, rounded down) to file facts."""
    days = days_per_year(F.col("year"))
    return facts.withColumn("days", days).withColumn("per_day", F.expr("num div days"))


def discover_variables(messages: DataFrame) -> DataFrame:
    """``file, var_ix, name, stride``: the names of a file up to the first that repeats.

    ``stride`` is the number of those names: the lowest message number that is not the first
    use of a name. All earlier numbers are first uses, so it is one above a first use and no
    first use itself - an anti join on the first uses, without ordering a file.
    """
    first_uses = messages.groupBy("file", "name").agg(F.min("msg_no").alias("first_use"))
    followers = first_uses.select("file", (F.col("first_use") + 1).alias("first_use"))
    stride = (
        followers.join(first_uses.select("file", "first_use"), ["file", "first_use"], "left_anti")
        .groupBy("file")
        .agg(F.min("first_use").alias("stride"))
    )
    return (
        first_uses.join(stride, "file")
        .where(F.col("first_use") < F.col("stride"))
        .select(
            "file",
            F.col("first_use").cast("int").alias("var_ix"),
            "name",
            F.col("stride").cast("int").alias("stride"),
        )
    )


def strides(discovered: DataFrame) -> DataFrame:
    """``file, stride`` of discovered variables."""
    return discovered.where(F.col("var_ix") == 0).select("file", "stride")


def assign_time(messages: DataFrame) -> DataFrame:
    """Time mode: ``year`` and ``month`` of the message's own time."""
    time = F.col("valid_time")
    return messages.withColumns({"year": F.year(time), "month": F.month(time)})


def assign_position(
    messages: DataFrame, facts: DataFrame, stride: int | None = None
) -> DataFrame:
    """Position mode: ``year``, ``month`` and ``var_ix`` from ``msg_no`` alone.

    Each day of the year takes the same whole number of messages; those after the last day are
    dropped, and so is a file with fewer messages than days. Within a month the variables take
    turns, ``stride`` of them. ``facts`` is ``file_facts`` (one row per file), with a ``stride``
    column if no number is given; pass it materialized, so the join knows its size.
    """
    width = F.lit(stride) if stride is not None else F.col("stride")
    day = F.col("_day")
    columns = messages.columns
    facts = messages_per_day(facts).where(F.col("per_day") > 0)
    result = [c for c in columns if c not in ("year", "month", "var_ix")]
    return (
        messages.drop("year", "month", "var_ix", "first_mean")
        .join(facts, "file")
        .withColumn("_day", F.expr("msg_no div per_day"))
        .where(day < F.col("days"))
        .withColumn("month", month_of_day(F.col("year"), day))
        .withColumn(
            "_place",
            F.col("msg_no") - F.col("per_day") * days_before_month_of_day(F.col("year"), day),
        )
        .withColumn("var_ix", (F.col("_place") % width).cast("int"))
        .withColumn("stride", width.cast("int"))
        .select(*result, "year", "month", "var_ix", "stride", "first_mean")
    )


def legacy_first_step(positioned: DataFrame) -> DataFrame:
    """Replace the means of the messages 0..stride of January by that of the first message.

    For results equal to those of the older job with discovered variables; off by default.
    """
    affected = (F.col("month") == 1) & (F.col("msg_no") <= F.col("stride"))
    mean = F.when(affected, F.col("first_mean")).otherwise(F.col("grid_mean"))
    return positioned.withColumn("grid_mean", mean)


def label_by_position(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``name``, the entry of ``names`` at ``var_ix``; rows beyond the list are dropped."""
    labels = F.array(*[F.lit(name) for name in names])
    labelled = table.withColumn("name", F.get(labels, F.col("var_ix")))
    return labelled.where(F.col("name").isNotNull())


def value_at(messages: DataFrame, day: dt.date, hour: int) -> DataFrame:
    """Messages of one hour of one day, as a time range that reaches the scan."""
    start = dt.datetime(day.year, day.month, day.day, hour)
    return messages.where(_between("valid_time", start, start + dt.timedelta(hours=1)))


def _between(column: str, start: dt.datetime, end: dt.datetime) -> Column:
    def bound(moment: dt.datetime) -> Column:
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")

    return (F.col(column) >= bound(start)) & (F.col(column) < bound(end))
