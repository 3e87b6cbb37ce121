"""The whole job for a folder that grows: only files that are new or changed are decoded.

Each file leaves a small state: the exact sum and the count of its message means per year, month
and variable. States of files add up to the monthly means in any order, to the last bit, so a
job over what has changed gives the same tables as one over everything, and a file that was
withdrawn or replaced takes its share with it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill import sinks
from gridmill.functions.exact import SUMS, exact_sums, mean_of, merge_sums
from gridmill.operators import messages as msg
from gridmill.operators import monthly as mon
from gridmill.operators import periods as per
from gridmill.operators import series as ser
from gridmill.plans.climate import DISCOVERY, MODES, Outcome, _summarize, decoded_messages
from gridmill.sources import files as src
from gridmill.sources.isolation import Limits
from gridmill.sources.ledger import Change, FileLedger
from gridmill.sources.published import new_run, publish
from gridmill.sources.scratch import materialize, scratch_in

_STATE = ["file", "year", "month", "name", "place", "count", "sums", "error"]


def file_states(
    files: DataFrame,
    decoder: src.Decoder,
    mode: str = "time",
    decode_by: str = "content",
    range_bytes: int = src.RANGE_BYTES,
    labels: Sequence[str] | None = None,
    stride: int | None = None,
    discovery: str = "first_repeat",
    keys: Sequence[int] = (),
    limits: Limits | None = None,
) -> DataFrame:
    """``file, year, month, name, place, count, sums, error`` of each file of a scan: what it adds
    to the monthly means, with the place of a variable's first use in it, and a row with ``error`` for
    a file that did not decode. A file without a month by position has one row with its year.
    ``labels`` are the variables of position mode, by default those that each file has."""
    messages, bad = decoded_messages(files, decoder, mode, decode_by, range_bytes, limits, keys)
    if mode == "time":
        timed = msg.assign_time(messages)
        sums = exact_sums(timed, ["file", "year", "month", "name"], "grid_mean")
        first = messages.groupBy("file", "name").agg(F.min("msg_no").alias("place"))
        good = sums.join(first, ["file", "name"])
    else:
        facts = materialize(msg.file_facts(messages), "facts")
        if labels is not None:
            placed = msg.assign_position(messages, facts, len(labels) if stride is None else stride)
        else:
            find = msg.discover_variables if discovery == "first_repeat" else per.discover_periods
            found = materialize(find(messages), "variables")
            strides = msg.strides(found)
            if stride is not None:
                strides = strides.withColumn("stride", F.lit(stride))
            placed = msg.assign_position(messages, materialize(facts.join(strides, "file"), "strides"))
        sums = materialize(exact_sums(placed, ["file", "year", "month", "var_ix"], "grid_mean"), "sums")
        if labels is not None:
            good = msg.label_by_position(sums, labels)
        else:
            good = sums.join(found.select("file", "var_ix", "name"), ["file", "var_ix"])
        good = good.withColumn("place", F.col("var_ix").cast("bigint")).drop("var_ix")
        short = facts.join(sums.select("file").distinct(), "file", "left_anti")
        good = good.unionByName(short.select("file", "year"), allowMissingColumns=True)
    good = good.withColumn("error", F.lit(None).cast("string"))
    # By the name that the listing has.
    return good.select(_STATE).unionByName(bad, allowMissingColumns=True).select(
        "file", F.col("year").cast("int"), F.col("month").cast("int"), "name", F.col("place").cast("bigint"),
        F.col("count").cast("bigint"), F.col("sums").cast(SUMS), "error",
    )


def run_incremental(
    spark: SparkSession,
    source: str,
    target: str,
    decoder: src.Decoder,
    variables: Sequence[str] | None = None,
    mode: str = "time",
    glob: str = "*.grib",
    decode_by: str = "content",
    chosen: Sequence[str] | None = None,
    nan_policy: str = "skip",
    naming: str = "prefix",
    stride: int | None = None,
    years: Iterable[int] | None = None,
    range_bytes: int = src.RANGE_BYTES,
    layout: str = "wide",
    keys: Sequence[int] = (),
    discovery: str = "first_repeat",
    limits: Limits | None = Limits(),  # noqa: B008 - never changed
) -> tuple[Outcome, Change]:
    """``run`` over all files under ``source``, decoding only those that no earlier call has seen as
    they are now. Returns the outcome and how many files were decoded, kept and withdrawn.

    States lie under ``target/_states``, results are published (see ``gridmill.sources.published``).
    The settings are those of ``run``; what shapes a file's state (``mode``, ``keys``, ``stride``,
    ``discovery``, and ``variables`` by position) must stay the same for a target. By position the last file of a year by name
    counts, by time all of its files are parts of it. Bad files stay listed until they change.
    """
    for value, allowed in ((mode, MODES), (discovery, DISCOVERY)):
        if value not in allowed:
            raise ValueError(f"{value!r} is none of {allowed}")
    base = target.rstrip("/")
    ledger = FileLedger(spark, f"{base}/_states")
    scratch = f"{base}/_scratch-{uuid.uuid4().hex}"
    run, folder = new_run(base)
    with scratch_in(scratch):
        files = src.scan_files(spark, source, glob)
        change = ledger.update(
            files,
            lambda changed: file_states(
                changed, decoder, mode, decode_by, range_bytes,
                variables if mode == "position" else None, stride, discovery, keys, limits,
            ),
        )
        states = ledger.rows()
        if states is None:
            raise ValueError(f"no file of {source} was ever seen")
        states = materialize(states, "states")
        bad = states.where(F.col("error").isNotNull()).select("file", "error")
        bad = materialize(bad.unionByName(src.empty_files(files)), "bad_files")
        bad.write.json(f"{folder}/bad_files")
        good = states.where(F.col("error").isNull()).drop("error")
        replaced = None
        if mode == "position":
            facts = good.groupBy("file", "year").agg(F.sum("count").alias("num"))
            replaced = materialize(mon.replaced_files(facts), "replaced")
            replaced.write.json(f"{folder}/replaced_files")
            good = good.join(replaced.select("file"), "file", "left_anti")
        monthly = merge_sums(good.where(F.col("month").isNotNull()), ["year", "month", "name"]).select(
            "year", "month", "name", mean_of(F.col("count"), F.col("sums")).alias("value")
        )
        names = list(variables or ())
        if variables is None and layout == "wide":
            uses = good.where(F.col("name").isNotNull()).groupBy("name").agg(
                F.min(F.struct("file", "place")).alias("first")
            )
            names = [r["name"] for r in uses.orderBy("first.file", "first.place", "name").collect()]
        if names:
            monthly = ser.select_variables(monthly, names)
        monthly = materialize(monthly, "monthly")
        empty = math.nan if nan_policy == "propagate" else None
        if layout == "long":
            dense = mon.dense_months(monthly, list(variables) if variables is not None else None, empty)
            sinks.write_monthly_long(dense, f"{folder}/monthly")
        else:
            shown = good.select("year").distinct() if mode == "position" else None
            dense = mon.dense_months(monthly, names, empty, shown)
            sinks.write_monthly(mon.monthly_wide(dense, names), f"{folder}/monthly")
        outcome = _summarize(
            dense, names, folder, chosen, nan_policy, naming, years, layout, bad_files=bad,
            replaced=replaced, folder=folder, scratch=scratch,
        )
    publish(spark, base, run)
    return outcome, change
