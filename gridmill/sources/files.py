"""Message files: scan, decode on the executors, report files that do not decode."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import Any
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.descriptions import stamp_year, valid_time, variable_name
from gridmill.sources.isolation import Failure, Limits, isolated
from gridmill.sources.scratch import materialize

# A decoder turns one file into its messages, in file order: (description, grid values).
Decoder = Callable[..., Iterable[tuple]]
DECODE_BY = ("content", "path", "range")

RANGE_BYTES = 256 * 1024 * 1024
# A row without its grid, about.
ROW_BYTES = 256
BATCH_BYTES = 8 * 1024 * 1024
# Rows that a decoder's own process sends at a time.
PIPE_BYTES = 1024 * 1024
# Ranges up to which each has a task of its own. A task costs some hundredths of a second to start,
# which is more than decoding a small range.
RANGE_TASKS = 1000


def scan_files(spark: SparkSession, path: str, glob: str = "*.grib") -> DataFrame:
    """One row per file: path, modificationTime, length, content. The content is read only if
    it is selected. Spark leaves files of zero bytes out of every scan; ``file_names`` has
    them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _plain_grid(values: Any) -> np.ndarray:
    if isinstance(values, np.ma.MaskedArray):
        values = values.astype("float64").filled(np.nan)
    return np.asarray(values, dtype="float64").ravel()


def _mean_of(values: Any) -> float | None:
    """Mean of the points that are there (neither masked nor NaN)."""
    if type(values) is list and 0 < len(values) < 8:
        # Numpy adds fewer than eight one after the other, too, but takes longer to begin.
        total = 0.0
        for value in values:
            if type(value) is not float:
                break
            total += value
        else:
            # Not NaN and not a zero, which has a sign.
            if total == total and total:
                return total / len(values)
    present = _plain_grid(values)
    total = present.sum()
    if np.isnan(total):
        present = present[~np.isnan(present)]
        total = present.sum()
    return float(total / present.size) if present.size else None


def deal_files(files: DataFrame, task_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """``path`` of each file, dealt to tasks by length: from the longest on, one to each task in turn.

    Any two tasks so differ by the longest file at most, and none holds more than that and the
    mean. Spark packs a listing until a task is full and gives the rest to whom it comes. By
    default there is a task for each ``task_bytes``, or for each core, and never more than files.
    """
    # Operators import this package.
    from gridmill.operators.numbering import number_rows

    listed = files.select(F.lit("all").alias("scan"), (-F.col("length")).alias("falling"), "path")
    numbered = number_rows(listed, "scan", ["falling", "path"], "place")
    count, total = numbered.agg(F.count("*"), -F.sum("falling")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(count, max(cores, -(-(total or 0) // task_bytes))))
    return numbered.repartitionById(tasks, (F.col("place") % tasks).cast("int")).select("path")


def reduce_grid(keep_values: bool) -> Callable[[Any], Any]:
    """What becomes of a grid next to its decoder."""
    return _plain_grid if keep_values else _mean_of


def in_batches(rows: Iterable[tuple], size_of: Callable[[tuple], int], most: int) -> Iterator[list]:
    """Lists of rows of at most ``most`` bytes; a row that is longer is a list by itself."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        bytes_of_row = size_of(row)
        if held and size + bytes_of_row > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += bytes_of_row
    if held:
        yield held


def openable(uri: str) -> str:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri


def file_names(files: DataFrame) -> DataFrame:
    """``file`` of all files of a scan, also those of zero bytes. The driver has the listing
    anyway, as it plans the scan from it."""
    names = pa.array(files.inputFiles(), pa.string())
    return files.sparkSession.createDataFrame(pa.table({"file": names}))


def _same_name(file: Column) -> Column:
    """A scan and a listing write the same local path with one slash and with three."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def empty_files(files: DataFrame) -> DataFrame:
    """``file, error`` of the files of zero bytes, which a scan leaves out."""
    listed = file_names(files).select(_same_name(F.col("file")).alias("file"))
    scanned = files.select(_same_name(F.col("path")).alias("file"))
    return listed.join(scanned, "file", "left_anti").withColumn("error", F.lit("file of zero bytes"))


def split_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, start, end``: each file cut into byte ranges, one task each, so that one huge file
    is decoded by as many tasks as the same bytes in many files. More than ``RANGE_TASKS`` of them are
    dealt to that many tasks, each with as many that follow each other, or to one for each
    ``RANGE_BYTES`` where these are more: the number of tasks does not follow that of small ranges.

    Ranges are numbered without gaps, and a range's number tells its partition: hashing would give
    some tasks several ranges and others none.
    """
    # Operators import this package.
    from gridmill.operators.numbering import number_rows

    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    end = F.least(F.col("start") + range_bytes, F.col("length"))
    ranges = ranges.select(F.lit("all").alias("scan"), "path", "start", end.alias("end"))
    numbered = number_rows(ranges, "scan", ["path", "start"], "range").drop("scan")
    count, total = numbered.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    tasks = range_tasks(count, total or 0)
    task = F.floor(F.col("range") * tasks / max(count, 1)).cast("int")
    return numbered.repartitionById(tasks, task).drop("range")


def range_tasks(ranges: int, total: int) -> int:
    """Tasks for a number of ranges of ``total`` bytes."""
    return max(1, min(ranges, max(RANGE_TASKS, -(-total // RANGE_BYTES))))


def decode_files(
    files: DataFrame,
    decoder: Decoder,
    by: str = "content",
    keep_values: bool = False,
    batch_bytes: int = BATCH_BYTES,
    range_bytes: int = RANGE_BYTES,
    limits: Limits | None = None,
) -> DataFrame:
    """Expand each file to its messages, numbered from 0 in file order.

    ``by`` says what the decoder gets:

    - ``"content"``: the bytes of the file as a buffer, which is not copied; Spark reads them.
      Longer files than ``spark.sql.sources.binaryFile.maxLength`` are left to the report.
    - ``"path"``: the path. The bytes never pass through the JVM, the decoder streams the file,
      and a file of any size needs the memory of one message. ``deal_files`` gives the tasks of a
      large listing about the same to do.
    - ``"range"``: path, start and end of a byte range. The decoder gives ``(offset, description,
      values)`` of the messages that begin in it; ``msg_no`` is that offset, and ``range_start`` and
      ``range_no`` say in which range a message is the how-manieth, from which ``number_by_range``
      makes a count. For files too long for one task.

    Each grid is reduced to its mean next to the decoder, so eight bytes per message leave the
    task; ``keep_values=True`` keeps the whole grids instead. Rows leave
    in batches of about ``batch_bytes``. A file that fails, or by content or path holds no message,
    gives one more row with ``error`` set; see ``split_decoded``. With ``limits`` the decoder runs in
    a process of its own, so a file whose decoder crashes or hangs is reported like any other.
    """
    reduced = reduce_grid(keep_values)
    values = ("values", pa.list_(pa.float64())) if keep_values else ("grid_mean", pa.float64())

    def cells(number: int, message: tuple) -> tuple:
        description, grid = message[-2:]
        return str(description), reduced(grid)

    def size_of(row: tuple) -> int:
        return ROW_BYTES + (row[3].nbytes if keep_values and row[3] is not None else 0)

    return expand_files(
        files, decoder, by, [("description", pa.string()), values], cells, size_of, batch_bytes,
        range_bytes, limits,
    )


_SQL_TYPES = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double"}


def expand_files(
    files: DataFrame,
    decoder: Decoder,
    by: str,
    columns: list[tuple[str, pa.DataType]],
    cells: Callable[[int, tuple], tuple],
    size_of: Callable[[tuple], int],
    batch_bytes: int,
    range_bytes: int,
    limits: Limits | None,
) -> DataFrame:
    """``file, msg_no, <columns>, error`` (by range also ``range_start, range_no``): ``cells`` makes
    the columns of a message from its number, or its offset by range, and what the decoder gave."""
    if by not in DECODE_BY:
        raise ValueError(f"by must be one of {DECODE_BY}, not {by!r}")
    fields = [("file", pa.string()), ("msg_no", pa.int64()), *columns, ("error", pa.string())]
    if by == "range":
        fields += [("range_start", pa.int64()), ("range_no", pa.int64())]
    layout = pa.schema(fields)
    blank = (None,) * len(columns)

    def rows_of(file: str, arguments: list, met: Callable[[], None] | None) -> Iterator[tuple]:
        number = -1
        try:
            for number, message in enumerate(decoder(*arguments)):
                if met is not None:
                    met()
                if by == "range":
                    place = message[0]
                    yield file, place, *cells(place, message), None, arguments[1], number
                else:
                    yield file, number, *cells(number, message), None
            if number < 0 and by != "range":
                raise ValueError("no messages")
        except Exception as failure:
            yield failed(file, f"{type(failure).__name__}: {failure}")

    def failed(file: str, reason: str) -> tuple:
        return file, None, *blank, reason, *((None, None) if by == "range" else ())

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(column, type=field.type) for column, field in zip(zip(*rows), layout)]
        return pa.RecordBatch.from_arrays(arrays, schema=layout)

    def arguments_of(batch: pa.RecordBatch, row: int) -> tuple[str, list]:
        file = batch.column(0)[row].as_py()
        if by == "content":
            return file, [memoryview(batch.column(1)[row].as_buffer())]
        return file, [openable(file), *(column[row].as_py() for column in batch.columns[1:])]

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from rows_of(*arguments_of(batch, row), None)

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The decoder's process makes the batches, so its worker has no row in hand.
        for batch in batches:

            def work(row: int, met: Callable[[], None], batch: pa.RecordBatch = batch) -> Iterator[pa.RecordBatch]:
                for rows in in_batches(rows_of(*arguments_of(batch, row), met), size_of, part_bytes):
                    yield to_batch(rows)

            for part in isolated(work, batch.num_rows, limits):
                if isinstance(part, Failure):
                    yield to_batch([failed(batch.column(0)[part.file].as_py(), part.reason)])
                else:
                    yield part

    part_bytes = min(PIPE_BYTES, batch_bytes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if limits is not None:
            # Small files give small parts.
            for parts in in_batches(zip(all_parts(batches)), lambda part: part[0].nbytes, part_bytes):
                yield from pa.Table.from_batches([part for (part,) in parts]).combine_chunks().to_batches()
            return
        for rows in in_batches(all_rows(batches), size_of, batch_bytes):
            yield to_batch(rows)

    if by == "range":
        sources = split_files(files, range_bytes)
    elif by == "path":
        sources = files.select("path")
    else:
        # The condition reaches the scan, which would else fail on the first long file.
        sources = files.where(F.col("length") <= _content_limit(files.sparkSession))
        sources = sources.select("path", "content")
    schema = ", ".join(
        f"{name} {_SQL_TYPES.get(kind) or 'array<double>'}" for name, kind in fields
    )
    return sources.mapInArrow(decode, schema)


def _content_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def split_decoded(
    decoded: DataFrame, files: DataFrame | None = None, by: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """(messages of the files that decoded whole, bad files as ``file, error``).

    A file that failed half-way gives no message at all. Decoding is the dear step, so its
    output is written once and both results read it back. With ``files``, the scan that was
    decoded, and ``by``, how, files that gave no row at all are reported too: those of zero bytes,
    those without a message in any range, and those too long to be read as content.
    """
    decoded = materialize(decoded, "decoded")
    # One row per file; each file is told apart by the name that scan and listing share.
    found = decoded.groupBy("file").agg(F.min("error").alias("error")).select(
        "file", "error", F.lit(True).alias("seen"), F.lit(None).cast("bigint").alias("length")
    )
    if files is None:
        bad = found.where(F.col("error").isNotNull()).select("file", "error")
    else:
        none = F.lit(None).cast("string")
        scanned = files.select(
            none.alias("file"), none.alias("error"), F.lit(None).cast("boolean").alias("seen"),
            "length", F.col("path").alias("_name"),
        )
        listed = file_names(files).select(
            none.alias("file"), none.alias("error"), F.lit(None).cast("boolean").alias("seen"),
            F.lit(None).cast("bigint").alias("length"), F.col("file").alias("_name"),
        )
        every = found.withColumn("_name", F.col("file")).unionByName(scanned).unionByName(listed)
        too_long = (F.lit(by) == "content") & (F.col("length") > _content_limit(files.sparkSession))
        silent = (
            F.when(F.col("length").isNull(), "file of zero bytes")
            .when(too_long, "too long to be read as content: use path or range")
            .otherwise("no messages")
        )
        bad = (
            every.groupBy(_same_name(F.col("_name")).alias("_name"))
            .agg(*[F.max(c).alias(c) for c in ("file", "error", "seen", "length")])
            .where(F.col("error").isNotNull() | F.col("seen").isNull())
            .select(
                F.coalesce("file", "_name").alias("file"),
                F.coalesce("error", silent).alias("error"),
            )
        )
    bad = materialize(bad, "bad_files")
    good = decoded.where(F.col("error").isNull()).drop("error")
    return good.join(bad.select("file"), "file", "left_anti"), bad


def flag_unreadable(
    messages: DataFrame, required: Sequence[str], first_message_only: bool = False
) -> DataFrame:
    """A message whose description lacks a required field becomes an error of its file."""
    lacking = reduce(or_, [F.col(field).isNull() for field in required])
    if first_message_only:
        lacking = lacking & (F.col("msg_no") == 0)
    reason = F.concat(F.lit(f"message without {' or '.join(required)}: number "), F.col("msg_no"))
    return messages.withColumn("error", F.coalesce("error", F.when(lacking, reason)))


def describe(messages: DataFrame) -> DataFrame:
    """Add ``name``, ``year`` and ``valid_time`` from the description."""
    text = F.col("description")
    return messages.withColumns(
        {"name": variable_name(text), "year": stamp_year(text), "valid_time": valid_time(text)}
    )
