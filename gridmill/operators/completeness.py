"""What is missing in files, and what position mode can't use of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.operators.messages import messages_per_day
from gridmill.operators.numbering import number_rows
from gridmill.sources.scratch import materialize

COLUMNS = ["file", "problem", "begins", "ends", "number"]


def time_steps(messages: DataFrame) -> DataFrame:
    """Stored ``file, valid_time, messages, step_no``: the distinct times of each file in order."""
    steps = (
        messages.where(F.col("valid_time").isNotNull())
        .groupBy("file", "valid_time")
        .agg(F.count("*").alias("messages"))
    )
    return materialize(number_rows(steps, "file", ["valid_time"], "step_no"), "time_steps")


def missing_steps(messages: DataFrame, step_seconds: int | None = None) -> DataFrame:
    """``file, problem, begins, ends, number``: each stretch of time steps that a file lacks between
    its first and its last, and how many steps (problem ``missing steps``); and the steps that have
    fewer or more messages than most of their file, as one row (``uneven steps``).

    The step of a file is ``step_seconds``, or the distance at which most of its times follow
    each other (of equally frequent ones the shortest). Files of one time have no gaps.
    """
    steps = time_steps(messages)
    after = steps.select(
        "file", F.col("valid_time").alias("ends"), (F.col("step_no") - 1).alias("step_no")
    )
    distance = F.expr("timestampdiff(SECOND, begins, ends)")
    pairs = materialize(
        steps.select("file", "step_no", F.col("valid_time").alias("begins"))
        .join(after, ["file", "step_no"])
        .withColumn("seconds", distance)
        .select("file", "begins", "ends", "seconds"),
        "step_pairs",
    )
    if step_seconds is not None:
        usual = pairs.select("file").distinct().withColumn("usual", F.lit(step_seconds).cast("bigint"))
    else:
        often = pairs.groupBy("file", "seconds").agg(F.count("*").alias("times"))
        usual = often.groupBy("file").agg(
            F.max_by("seconds", F.struct("times", -F.col("seconds"))).alias("usual")
        )
    step = F.expr("make_dt_interval(0, 0, 0, usual)")
    gaps = (
        pairs.join(usual, "file")
        .where(F.col("seconds") > F.col("usual"))
        .select(
            "file",
            F.lit("missing steps").alias("problem"),
            (F.col("begins") + step).cast("timestamp_ntz").alias("begins"),
            (F.col("ends") - step).cast("timestamp_ntz").alias("ends"),
            (F.ceil(F.col("seconds") / F.col("usual")) - 1).cast("bigint").alias("number"),
        )
    )
    counts = steps.groupBy("file", "messages").agg(F.count("*").alias("times"))
    most = counts.groupBy("file").agg(F.max_by("messages", F.struct("times", "messages")).alias("usual"))
    uneven = (
        steps.join(most, "file")
        .where(F.col("messages") != F.col("usual"))
        .groupBy("file")
        .agg(
            F.min("valid_time").alias("begins"), F.max("valid_time").alias("ends"),
            F.count("*").alias("number"),
        )
        .withColumn("problem", F.lit("uneven steps"))
    )
    return gaps.select(COLUMNS).unionByName(uneven.select(COLUMNS))


def dropped_by_position(facts: DataFrame) -> DataFrame:
    """The same columns for what position mode leaves out, without times: the messages behind the
    last day of a file (``after the last day``) and files with fewer messages than days
    (``fewer messages than days``), with the number of messages. ``facts`` is ``file_facts``."""
    counted = messages_per_day(facts)
    none = F.lit(None).cast("timestamp_ntz")
    behind = F.col("num") - F.col("per_day") * F.col("days")
    return (
        counted.where(behind > 0)
        .select(
            "file",
            F.when(F.col("per_day") > 0, "after the last day").otherwise("fewer messages than days").alias("problem"),
            none.alias("begins"),
            none.alias("ends"),
            behind.cast("bigint").alias("number"),
        )
        .select(COLUMNS)
    )
