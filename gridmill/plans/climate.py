"""Whole jobs: message files to monthly tables, yearly summary and trend series."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill import sinks
from gridmill.operators import completeness as full
from gridmill.operators import messages as msg
from gridmill.operators import monthly as mon
from gridmill.operators import periods as per
from gridmill.operators import series as ser
from gridmill.operators import yearly as yr
from gridmill.sources import files as src
from gridmill.sources import published as pub
from gridmill.sources import tables as tab
from gridmill.sources.index import Indexer, MessageDecoder, MessageIndex, read_messages
from gridmill.sources.isolation import Limits
from gridmill.sources.scratch import delete_folder, materialize, scratch_in

MODES = ("time", "position")
LAYOUTS = ("wide", "long")
COLUMNS = ("all", "first_file")
MONTHLY_FILES = ("folders", "year_files")
DISCOVERY = ("first_repeat", "period")


@dataclass(frozen=True)
class Outcome:
    """Results of a job. ``monthly`` is long (``year, month, name, value``); ``yearly`` is wide, or
    ``name, year, min, max, avg`` in the long layout, where ``variables`` is empty as no list of
    names is ever made. ``yearly`` and ``series`` are None if no variable was chosen.

    ``bad_files``: files, cells or names that were not used, with the reason. ``replaced``: files
    that gave way to the last of their year. ``left_out``: names that the first file lacks.
    ``incomplete``: see ``gridmill.operators.completeness``. ``folder``: where the results lie. The
    tables read scratch under the target; ``release`` deletes it after their last use.
    """

    variables: list[str]
    monthly: DataFrame
    yearly: DataFrame | None
    series: DataFrame | None
    bad_files: DataFrame | None = None
    lacking: tuple[str, ...] = ()
    replaced: DataFrame | None = None
    left_out: DataFrame | None = None
    incomplete: DataFrame | None = None
    folder: str | None = None
    scratch: str | None = None

    def release(self) -> None:
        if self.scratch is not None:
            delete_folder(self.monthly.sparkSession, self.scratch)


def monthly_from_messages(
    messages: DataFrame,
    mode: str = "time",
    variables: Sequence[str] | None = None,
    stride: int | None = None,
    legacy_first_step: bool = False,
    same_year: str | None = None,
    facts: DataFrame | None = None,
    discovered: DataFrame | None = None,
) -> DataFrame:
    """Message means to ``year, month, name, value``.

    ``same_year`` says what several files of one year are: with ``"merge"`` they are parts of the
    year (the default by time, where each message has its own), with ``"last"`` the last by name
    replaces the others (the only way by position); see ``replaced_files``.

    Time mode groups on each message's own time and name. Position mode uses the message number
    only: with ``variables`` they take turns in list order, ``stride`` of them (the length of
    the list by default); without, each file's own variables are discovered. ``facts`` and
    ``discovered`` may give what ``file_facts`` and ``discover_variables`` have found already.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    same_year = same_year or ("merge" if mode == "time" else "last")
    if same_year not in ("last", "merge") or (same_year == "merge" and mode == "position"):
        raise ValueError(f"same_year={same_year!r} does not go with mode={mode!r}")
    if same_year == "merge":
        monthly = mon.monthly_mean(msg.assign_time(messages))
        return monthly if variables is None else ser.select_variables(monthly, variables)

    if mode == "time":
        files = msg.file_year(messages) if facts is None else facts.select("file", "year")
        kept = materialize(mon.keep_last_files(files).select("file"), "kept_files")
        timed = msg.assign_time(messages.join(kept, "file", "left_semi"))
        monthly = mon.monthly_mean(timed)
        return monthly if variables is None else ser.select_variables(monthly, variables)

    facts = mon.keep_last_files(msg.file_facts(messages) if facts is None else facts)
    if variables is not None:
        facts = materialize(facts, "file_facts")
        width = len(variables) if stride is None else stride
        positioned = msg.assign_position(messages, facts, width)
    else:
        if discovered is None:
            discovered = materialize(msg.discover_variables(messages), "variables")
        per_file = msg.strides(discovered)
        if stride is not None:
            per_file = per_file.withColumn("stride", F.lit(stride))
        facts = materialize(facts.join(per_file, "file"), "file_facts")
        positioned = msg.assign_position(messages, facts)
    if legacy_first_step:
        positioned = msg.legacy_first_step(positioned)
    if variables is not None:
        monthly = mon.monthly_mean(positioned, ["year", "month", "var_ix"])
        monthly = msg.label_by_position(monthly, variables)
    else:
        monthly = mon.monthly_mean(positioned, ["file", "year", "month", "var_ix"])
        names = discovered.select("file", "var_ix", "name")
        monthly = monthly.join(names, ["file", "var_ix"])
    return monthly.select("year", "month", "name", "value")


def first_uses(messages: DataFrame) -> DataFrame:
    """``name, file, place``: the first file by name, and the place in it, that uses a variable."""
    first = F.min(F.struct("file", F.col("msg_no").alias("place"))).alias("first")
    return messages.where(F.col("name").isNotNull()).groupBy("name").agg(first).select("name", "first.*")


def first_positions(discovered: DataFrame) -> DataFrame:
    """The same for discovered variables, which end at a file's first repeat."""
    first = F.min(F.struct("file", F.col("var_ix").cast("bigint").alias("place"))).alias("first")
    return discovered.where(F.col("name").isNotNull()).groupBy("name").agg(first).select("name", "first.*")


def _in_order(uses: DataFrame) -> list[str]:
    """The names as columns of a wide table; their list is its header."""
    return [row["name"] for row in uses.orderBy("file", "place", "name").collect()]


def _of_first_file(uses: DataFrame) -> DataFrame:
    """A name of the first file is first used there."""
    return uses.join(uses.agg(F.min("file").alias("file")), "file", "left_semi").select(uses.columns)


def first_file_variables(messages: DataFrame, mode: str = "time") -> list[str]:
    """Variables of the first file by name, in file order. In position mode these are the
    discovered ones, which end at the first repeat."""
    first = messages.agg(F.min("file").alias("file"))
    own = messages.join(first, "file", "left_semi")
    uses = first_positions(msg.discover_variables(own)) if mode == "position" else first_uses(own)
    return _in_order(uses)


def decoded_messages(
    files: DataFrame,
    decoder: src.Decoder,
    mode: str = "time",
    decode_by: str = "content",
    range_bytes: int = src.RANGE_BYTES,
    limits: Limits | None = None,
    keys: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """Stored messages of a scan's files, with ``name, year, valid_time, grid_mean`` and a number,
    and bad files as ``file, error``."""
    sources = src.deal_files(files, range_bytes) if decode_by == "path" else files
    decoded = src.decode_files(sources, decoder, decode_by, range_bytes=range_bytes, limits=limits)
    # The descriptions are taken apart in the decoding stage, and only their fields are kept.
    described = src.describe(decoded)
    if keys:
        described = per.with_keys(described, keys)
    described = described.drop("description")
    if mode == "time":
        described = src.flag_unreadable(described, ["name", "valid_time"])
    else:
        described = src.flag_unreadable(described, ["year"], first_message_only=True)
    messages, bad = src.split_decoded(described, files, decode_by)
    if decode_by == "range" and mode == "position":
        messages = msg.number_by_range(messages)
    return messages, bad


def indexed_messages(
    book: MessageIndex,
    files: DataFrame,
    decoder: MessageDecoder,
    names: Sequence[str] | None = None,
    at: dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same from an index: only messages of ``names``, and of a day and hour, are fetched from
    their files and decoded. A file with a message that can't be read is a bad file."""
    rows = src.describe(book.messages(names, at).drop("name", "year", "valid_time"))
    rows = src.flag_unreadable(rows.withColumn("error", F.lit(None).cast("string")), ["name", "valid_time"])
    odd = rows.where(F.col("error").isNotNull()).select("file", "error")
    read = materialize(read_messages(rows.where(F.col("error").isNull()), decoder), "fetched")
    failed = read.where(F.col("error").isNotNull()).select("file", "error").unionByName(odd)
    bad = failed.groupBy("file").agg(F.min("error").alias("error"))
    bad = materialize(bad.unionByName(book.bad_files()).unionByName(src.empty_files(files)), "bad_files")
    good = read.where(F.col("error").isNull()).drop("error", "offset", "length")
    return good.join(bad.select("file"), "file", "left_anti"), bad


def run(
    spark: SparkSession,
    source: str,
    target: str,
    decoder: src.Decoder | MessageDecoder,
    variables: Sequence[str] | None = None,
    mode: str = "time",
    glob: str = "*.grib",
    decode_by: str = "content",
    chosen: Sequence[str] | None = None,
    nan_policy: str = "skip",
    naming: str = "prefix",
    legacy_first_step: bool = False,
    stride: int | None = None,
    same_year: str | None = None,
    years: Iterable[int] | None = None,
    range_bytes: int = src.RANGE_BYTES,
    columns: str = "all",
    layout: str = "wide",
    monthly_files: str = "folders",
    at: dt.datetime | None = None,
    keys: Sequence[int] = (),
    discovery: str = "first_repeat",
    check_steps: bool = False,
    publish: bool = False,
    limits: Limits | None = Limits(),  # noqa: B008 - never changed
    index: str | None = None,
    indexer: Indexer | None = None,
) -> Outcome:
    """Files under ``source`` to tables under ``target``: ``monthly``, ``summary``, ``series``,
    ``series_span``, ``bad_files``, and where they apply ``replaced_files``, ``left_out``,
    ``incomplete_files`` and ``values``.

    ``variables``: the list of variables; by default those of all files (``columns="all"``), in
    the order of their first use, or only those of the first file (``"first_file"``), which lists
    the others in ``left_out``. ``chosen``: variables of the summary and the series (default all);
    an empty list stops after the monthly tables. ``years``: the years of the summary, with nulls
    where there are no data (default: those with data). ``nan_policy="propagate"`` also makes a
    month without messages NaN instead of null.

    ``layout="long"`` writes ``name, value`` rows instead of a column per variable, for any number
    of variables. ``monthly_files="year_files"`` writes plain ``YYYY.csv`` files, which
    ``summarize_folder`` reads as it reads the folders. ``at``: also write the values at this day
    and hour (time mode). ``decode_by``, ``range_bytes`` and ``limits``: see ``decode_files``; by
    default each decoder runs in a process of its own and may take ten minutes for a message
    (``limits=None``: in the worker). The other settings: see ``monthly_from_messages`` and
    ``yearly_stats``.

    ``keys``: fields of the description (from 1) that tell variables of one name apart, such as the
    level; their values stand behind the name. ``discovery="period"`` finds the variables of
    position mode from the period of a file's names, also where a name returns within a time step.
    ``incomplete_files`` lists what position mode drops; with ``check_steps`` also the time steps
    that files lack. ``publish=True`` writes into a folder of this run and makes it the one that
    holds when all is written (see ``gridmill.sources.published``): a job that dies leaves the
    former results whole, and the years of former runs are not part of these.

    ``index``: a folder with the index of the messages (time mode). It is brought up to date with
    ``indexer``, then only messages of ``variables``, and those ``at`` a day and hour, are read;
    ``decoder`` gets the bytes of one message and returns its grid. See ``gridmill.sources.index``.
    """
    if index is not None and (indexer is None or mode != "time" or keys):
        raise ValueError("an index needs an indexer, and goes with time mode without keys")
    choices = (
        (layout, LAYOUTS), (columns, COLUMNS), (monthly_files, MONTHLY_FILES), (discovery, DISCOVERY),
    )
    for value, allowed in choices:
        if value not in allowed:
            raise ValueError(f"{value!r} is none of {allowed}")
    if layout == "long" and (monthly_files == "year_files" or columns == "first_file"):
        raise ValueError("a long table has no columns to choose and no plain year files")
    scratch = f"{target.rstrip('/')}/_scratch-{uuid.uuid4().hex}"
    base, run_name = target, None
    if publish:
        run_name, target = pub.new_run(base)
    with scratch_in(scratch):
        files = src.scan_files(spark, source, glob)
        if index is None:
            messages, bad = decoded_messages(files, decoder, mode, decode_by, range_bytes, limits, keys)
            at_hour = None if at is None else msg.value_at(messages, at.date(), at.hour)
        else:
            book = MessageIndex(spark, index)
            book.refresh(files, indexer, "path", limits)
            messages, bad = indexed_messages(book, files, decoder, variables)
            at_hour = None if at is None else indexed_messages(book, files, decoder, variables, at)[0]
        bad.write.mode("overwrite").json(f"{target}/bad_files")
        if at_hour is not None:
            sinks.write_table(at_hour, f"{target}/values")

        facts = discovered = replaced = left_out = incomplete = None
        if mode == "position" or same_year == "last":
            facts = materialize(msg.file_facts(messages), "facts")
            replaced = materialize(mon.replaced_files(facts), "replaced")
            replaced.write.mode("overwrite").json(f"{target}/replaced_files")
        if mode == "position":
            incomplete = full.dropped_by_position(facts)
        if check_steps:
            missing = full.missing_steps(messages)
            incomplete = missing if incomplete is None else incomplete.unionByName(missing)
        if incomplete is not None:
            incomplete = materialize(incomplete, "incomplete")
            incomplete.write.mode("overwrite").json(f"{target}/incomplete_files")
        if mode == "position" and variables is None:
            find = msg.discover_variables if discovery == "first_repeat" else per.discover_periods
            discovered = materialize(find(messages), "variables")
        names = list(variables or ())
        if variables is None and layout == "wide":
            uses = first_uses(messages) if discovered is None else first_positions(discovered)
            if columns == "first_file":
                uses = materialize(uses, "first_uses")
                names = _in_order(_of_first_file(uses))
                left_out = uses.join(_of_first_file(uses), "name", "left_anti").select("name", "file")
                left_out.write.mode("overwrite").json(f"{target}/left_out")
            else:
                names = _in_order(uses)
        monthly = monthly_from_messages(
            messages, mode, variables, stride, legacy_first_step, same_year, facts, discovered
        )
        if names:
            monthly = ser.select_variables(monthly, names)
        monthly = materialize(monthly, "monthly")
        empty = math.nan if nan_policy == "propagate" else None
        if layout == "long":
            dense = mon.dense_months(monthly, list(variables) if variables is not None else None, empty)
            sinks.write_monthly_long(dense, f"{target}/monthly")
        else:
            # A file with fewer messages than days has no month by position, but its year is shown.
            shown = facts.select("year").distinct() if mode == "position" else None
            dense = mon.dense_months(monthly, names, empty, shown)
            write = sinks.write_monthly if monthly_files == "folders" else sinks.write_year_files
            write(mon.monthly_wide(dense, names), f"{target}/monthly")
        outcome = _summarize(
            dense, names, target, chosen, nan_policy, naming, years, layout, bad_files=bad,
            replaced=replaced, left_out=left_out, incomplete=incomplete, folder=target, scratch=scratch,
        )
    if run_name is not None:
        pub.publish(spark, base, run_name)
    return outcome


def summarize_folder(
    spark: SparkSession,
    source: str,
    target: str,
    variables: Sequence[str] | None = None,
    chosen: Sequence[str] | None = None,
    nan_policy: str = "skip",
    naming: str = "prefix",
    exclude_prefix: str = "summary_data",
    years: Iterable[int] | None = None,
    layout: str = "wide",
) -> Outcome:
    """The second half only: a folder of monthly tables to summary and series. The tables are
    ``YYYY.csv`` files or those of ``year=YYYY`` folders, as ``run`` writes them (wide), published
    ones too. A folder that holds both forms is refused: their years would mix.

    ``variables``: by default those of all headers. Files without a year and cells that
    are no numbers are left out and listed in ``bad_files``. No file with a
    year is an error.
    """
    scratch = f"{target.rstrip('/')}/_scratch-{uuid.uuid4().hex}"
    source = pub.followed(spark, source)
    sinks.refuse_mixed(spark, source)
    with scratch_in(scratch):
        cells = materialize(tab.monthly_cells(spark, source, exclude_prefix=exclude_prefix), "cells")
        bad = cells.where(F.col("error").isNotNull()).select("file", "error").distinct()
        bad.write.mode("overwrite").json(f"{target}/bad_files")
        if not cells.where(F.col("year").isNotNull()).head(1):
            raise ValueError(f"no file of {source} has a year in its name or folder")
        monthly = yr.valid_years(cells.where(F.col("error").isNull()).drop("error"))
        names = list(variables or ())
        if variables is None and layout == "wide":
            names = [r["name"] for r in monthly.select("name").distinct().orderBy("name").collect()]
        if names:
            monthly = ser.select_variables(monthly, names)
        return _summarize(
            monthly, names, target, chosen, nan_policy, naming, years, layout, bad_files=bad,
            scratch=scratch,
        )


def _summarize(
    monthly: DataFrame,
    names: list[str],
    target: str,
    chosen: Sequence[str] | None,
    nan_policy: str,
    naming: str,
    years: Iterable[int] | None,
    layout: str,
    **more,
) -> Outcome:
    if chosen is not None and not chosen:
        return Outcome(names, monthly, None, None, **more)
    spark = monthly.sparkSession
    if layout == "long":
        picked = monthly if chosen is None else ser.select_variables(monthly, chosen)
        yearly = yr.yearly_long(picked, nan_policy)
        if years is not None:
            spine = yearly.select("name").distinct().withColumn(
                "year", F.explode(F.array(*[F.lit(y) for y in years]))
            )
            yearly = spine.join(yearly, ["name", "year"], "left")
        yearly = materialize(yearly, "yearly")
        sinks.write_long(yearly, f"{target}/summary", "name")
        series = ser.trend_series_long(yearly)
        sinks.write_long(series, f"{target}/series", "variable")
        sinks.write_table(ser.series_span(series), f"{target}/series_span")
        return Outcome([], monthly, yearly, series, **more)
    yearly = yr.yearly_wide(yr.yearly_long(monthly, nan_policy), names, naming)
    if years is not None:
        yearly = yr.year_spine_join(yearly, yr.year_spine(spark, years), naming)
    sinks.write_summary(yearly, f"{target}/summary")
    summary = tab.read_summary(spark, f"{target}/summary", names, naming)
    picked = names if chosen is None else list(chosen)
    present, lacking = ser.select_summary(summary, picked, naming)
    series = ser.trend_series(present, [n for n in picked if n not in lacking], naming)
    sinks.write_series(series, f"{target}/series")
    sinks.write_table(ser.series_span(series), f"{target}/series_span")
    return Outcome(names, monthly, summary, series, lacking=tuple(lacking), **more)
