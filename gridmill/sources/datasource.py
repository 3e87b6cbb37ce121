"""Message files as a Spark data source: ``spark.read.format(name).load(folder)``.

Byte ranges of files are the input partitions (many small ranges share one), so one huge file is
read by many tasks. Conditions
on the file leave whole files out before a task is made; those on name and year are looked at as
soon as a message's description is known, and the grids of other messages are neither decoded
(where the decoder can put that off) nor reduced nor sent to the JVM.

Conditions come as options, or from the query's filters if Spark is set to push them into Python
sources. That is off by default, for Spark 4.1 keeps what a query has pushed with the DataFrame: a
later query of the same DataFrame without such a filter would silently get the rows of the former.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from gridmill.sources.files import RANGE_BYTES, in_batches, openable, range_tasks, reduce_grid

SCHEMA = (
    "file string, offset bigint, description string, name string, year int, valid_time timestamp_ntz,"
    " grid_mean double"
)
#: Spark offers the source a query's filters only with this setting.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ROW_BYTES = 256
_BATCH_BYTES = 8 * 1024 * 1024

_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda value, wanted: value == wanted,
    In: lambda value, wanted: value in wanted,
    GreaterThan: lambda value, wanted: value > wanted,
    GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    LessThan: lambda value, wanted: value < wanted,
    LessThanOrEqual: lambda value, wanted: value <= wanted,
    StringStartsWith: lambda value, wanted: value.startswith(wanted),
    StringEndsWith: lambda value, wanted: value.endswith(wanted),
}
_PUSHED = ("file", "name", "year")


class Ranges(InputPartition):
    """Ranges ``file, start, end`` of bytes."""

    def __init__(self, ranges: Sequence[tuple[str, int, int]]):
        self.ranges = ranges


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """``file, length`` of the files under a folder (or of one file) that match, in any store that
    Arrow knows; hidden ones and those of zero bytes are left out."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), openable(path))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else "file:"
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True))
    keep = []
    for one in found:
        hidden = any(part[:1] in "._" for part in one.path[len(inside) :].strip("/").split("/"))
        if one.is_file and one.size and fnmatch.fnmatchcase(one.base_name, glob) and (one is info or not hidden):
            keep.append((prefix + one.path, one.size))
    return sorted(keep)


def _stamp(description: str) -> tuple[str | None, int | None, dt.datetime | None]:
    """Name, year and time of a description, as the functions of ``gridmill.functions`` give them."""
    fields = description.split(":")
    name = fields[1] if len(fields) > 1 else None
    last = fields[-1][-12:]
    year = int(last[:4]) if len(last) == 12 and last[:4].isdecimal() and last[:4].isascii() else None
    try:
        parts = last[:4], last[4:6], last[6:8], last[8:10], last[10:]
        time = dt.datetime(*map(int, parts)) if len(last) == 12 and last.isdecimal() and last[4:].isascii() else None
    except ValueError:
        time = None
    return name, year, time


class MessageReader(DataSourceReader):
    def __init__(self, path: str, glob: str, range_bytes: int, decoder, tests: Sequence[tuple] = ()):
        self.path, self.glob, self.range_bytes, self.decoder = path, glob, range_bytes, decoder
        # Column, kind of filter and its value.
        self.tests: list[tuple[str, type, object]] = list(tests)

    def _passes(self, column: str, value) -> bool:
        return all(
            value is not None and _TESTS[kind](value, wanted)
            for name, kind, wanted in self.tests if name == column
        )

    def partitions(self) -> Sequence[InputPartition]:
        ranges = [
            (file, start, min(start + self.range_bytes, size))
            for file, size in listed(self.path, self.glob)
            if self._passes("file", file)
            for start in range(0, size, self.range_bytes)
        ]
        # As ``split_files`` deals them.
        tasks = range_tasks(len(ranges), sum(end - start for _, start, end in ranges))
        borders = [len(ranges) * task // tasks for task in range(tasks + 1)]
        return [Ranges(ranges[a:b]) for a, b in zip(borders, borders[1:]) if a < b]

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # Spark's way to read a source without partitions.
            return
        reduced = reduce_grid(False)

        def rows() -> Iterator[tuple]:
            for file, start, end in partition.ranges:
                for offset, description, grid in self.decoder(openable(file), start, end):
                    name, year, time = _stamp(str(description))
                    if self._passes("name", name) and self._passes("year", year):
                        values = grid() if callable(grid) else grid
                        yield file, offset, str(description), name, year, time, reduced(values)

        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us"), pa.float64())
        names = ("file", "offset", "description", "name", "year", "valid_time", "grid_mean")
        for held in in_batches(rows(), lambda row: _ROW_BYTES, _BATCH_BYTES):
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, list(names))


class PushingReader(MessageReader):
    """The same for a Spark that pushes filters; without the setting Spark refuses such a reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute if type(one) in _TESTS else ()
            if len(column) == 1 and column[0] in _PUSHED:
                self.tests.append((column[0], type(one), one.value))
            else:
                yield one


def message_source(format_name: str, decoder, pushdown: bool = False) -> type[DataSource]:
    """A data source called ``format_name`` for files of one codec; register it with
    ``spark.dataSource.register``.

    ``decoder`` is that of ``decode_files(by="range")``: path, start and end to ``(offset, description,
    grid)`` of the messages that begin in the range; the grid may be a function that decodes it.
    Options: ``glob`` (default ``*``) and ``range_bytes``; ``names``, a JSON list of variables, and
    ``years``, ``first-last`` or one, for what is to be read. A decoder that fails, fails the query:
    a job that must go on takes ``decode_files``. ``pushdown``: take the filters of queries, with
    the setting ``PUSHDOWN`` and a DataFrame for each query, see above.
    """

    class MessageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            tests = []
            if "names" in self.options:
                tests.append(("name", In, tuple(json.loads(self.options["names"]))))
            if "years" in self.options:
                first, _, last = self.options["years"].partition("-")
                tests.append(("year", GreaterThanOrEqual, int(first)))
                tests.append(("year", LessThanOrEqual, int(last or first)))
            made = PushingReader if pushdown else MessageReader
            return made(
                self.options["path"], self.options.get("glob", "*"),
                int(self.options.get("range_bytes", RANGE_BYTES)), decoder, tests,
            )

    return MessageSource


def register_source(spark: SparkSession, format_name: str, decoder, pushdown: bool = False) -> str:
    """Register ``message_source``; returns the name."""
    spark.dataSource.register(message_source(format_name, decoder, pushdown))
    return format_name
