"""An index of the messages in files, and reads that fetch only the bytes asked for.

One pass that looks at headers only stores where each message lies: ``file, msg_no, offset, length,
description, name, year, valid_time``. A choice of variables, or of a day and hour, is then a filter
on that table, which is sorted by name and time so that most of it is never read, and only
the ranges of the messages that are left are fetched from the files and decoded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.files import (
    BATCH_BYTES,
    RANGE_BYTES,
    ROW_BYTES,
    deal_files,
    describe,
    expand_files,
    in_batches,
    openable,
    reduce_grid,
)
from gridmill.sources.isolation import Limits
from gridmill.sources.ledger import Change, FileLedger
from gridmill.sources.scratch import materialize

# An indexer turns a file (what it gets is as for a decoder) into (offset, length, description).
Indexer = Callable[..., Iterable[tuple[int, int, str]]]
# A message decoder turns the bytes of one message into its grid.
MessageDecoder = Callable[[bytes], Any]

#: Bytes that are fetched at a time, and the gap between messages that is read along with them.
FETCH_BYTES = 8 * 1024 * 1024
GAP_BYTES = 64 * 1024
#: Messages that one task reads, about.
TASK_MESSAGES = 100_000


def open_file(uri: str) -> BinaryIO:
    """A file for reading at any place: plain files by the system, all other stores by Arrow."""
    path = openable(uri)
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def index_files(
    files: DataFrame,
    indexer: Indexer,
    by: str = "path",
    range_bytes: int = RANGE_BYTES,
    limits: Limits | None = None,
) -> DataFrame:
    """``file, msg_no, offset, length, description, error`` of all messages, without their grids.
    ``by``, ``range_bytes`` and ``limits``: see ``decode_files``; by range ``msg_no`` is the offset. A
    file that fails gives a row with ``error``."""

    def cells(number: int, message: tuple) -> tuple:
        offset, length, description = message
        return offset, length, str(description)

    columns = [("offset", pa.int64()), ("length", pa.int64()), ("description", pa.string())]
    return expand_files(
        files, indexer, by, columns, cells, lambda row: ROW_BYTES, BATCH_BYTES, range_bytes, limits
    )


class MessageIndex:
    """The index of all files of a folder, kept in ``path``, any Hadoop URI."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.ledger = FileLedger(spark, path)

    def refresh(
        self, files: DataFrame, indexer: Indexer, by: str = "path", limits: Limits | None = None
    ) -> Change:
        """Index the files that are new or changed since, and forget those that are gone."""

        def derive(changed: DataFrame) -> DataFrame:
            sources = deal_files(changed) if by == "path" else changed
            rows = describe(index_files(sources, indexer, by, limits=limits))
            # A file that failed half-way has no message that counts.
            rows = materialize(rows, "indexed")
            failed = rows.where(F.col("error").isNotNull()).select("file").distinct()
            whole = rows.where(F.col("error").isNull()).join(failed, "file", "left_anti")
            every = whole.select(rows.columns).unionByName(rows.where(F.col("error").isNotNull()))
            # Filters on name and time leave most row groups unread.
            return every.repartitionByRange("name", "valid_time").sortWithinPartitions("name", "valid_time")

        return self.ledger.update(files, derive)

    def _rows(self) -> DataFrame:
        rows = self.ledger.rows()
        if rows is None:
            raise ValueError("the index has never seen a file: refresh it first")
        return rows

    def messages(self, names: Sequence[str] | None = None, at: dt.datetime | None = None) -> DataFrame:
        """The indexed messages, of some variables, or of one day and hour. Further filters on the
        columns reach the stored table as well."""
        # Operators import this package.
        from gridmill.operators.messages import value_at

        rows = self._rows().where(F.col("error").isNull()).drop("error")
        if names is not None:
            rows = rows.where(F.col("name").isin(list(names)))
        return rows if at is None else value_at(rows, at.date(), at.hour)

    def bad_files(self) -> DataFrame:
        """``file, error`` of the files that could not be indexed."""
        return self._rows().where(F.col("error").isNotNull()).select("file", "error")


def read_messages(
    wanted: DataFrame,
    decoder: MessageDecoder,
    keep_values: bool = False,
    opener: Callable[[str], BinaryIO] = open_file,
    task_bytes: int = RANGE_BYTES,
    fetch_bytes: int = FETCH_BYTES,
    gap_bytes: int = GAP_BYTES,
) -> DataFrame:
    """The messages of ``wanted``, rows of an index, with ``grid_mean`` (or ``values``) and ``error``.

    Tasks take ranges of files of about ``task_bytes`` in all, of ``TASK_MESSAGES`` messages at most, so
    one file that holds most of the messages is read by many of them. Messages that lie closer than ``gap_bytes`` are fetched
    together, ``fetch_bytes`` at most. A message that can't be read, or a file that is gone or shorter
    than it was, gives a row with ``error``.
    """
    wanted = materialize(wanted.select("file", "msg_no", "offset", "length", "name", "year", "valid_time"), "wanted")
    # A small message costs what its row costs.
    total, count = wanted.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, -(-(total or 0) // task_bytes), -(-count // TASK_MESSAGES))
    kind = pa.list_(pa.float64()) if keep_values else pa.float64()
    reduced = reduce_grid(keep_values)
    value = "values" if keep_values else "grid_mean"

    def runs(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows of one file that are fetched together; rows are sorted."""
        held: list[tuple] = []
        end = 0
        for row in rows:
            if held:
                far = row[1] - end > gap_bytes or row[1] + row[2] - held[0][1] > fetch_bytes
                if row[0] != held[0][0] or far:
                    yield held
                    held = []
            end = max(end, row[1] + row[2]) if held else row[1] + row[2]
            held.append(row)
        if held:
            yield held

    def fetched(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        rows = [(*cells, i) for i, cells in enumerate(zip(*columns, strict=True))]
        name, source = None, None
        try:
            for group in runs(rows):
                try:
                    if group[0][0] != name:
                        if source is not None:
                            source.close()
                        name, source = group[0][0], None
                        source = opener(name)
                    begin, end = group[0][1], max(r[1] + r[2] for r in group)
                    source.seek(begin)
                    data = source.read(end - begin)
                except Exception as failure:
                    name = None
                    for row in group:
                        yield row[3], None, f"{type(failure).__name__}: {failure}"
                    continue
                for _, offset, length, i in group:
                    part = data[offset - begin : offset - begin + length]
                    try:
                        if len(part) < length:
                            raise EOFError("the file is shorter than its index")
                        yield i, reduced(decoder(part)), None
                    except Exception as failure:
                        yield i, None, f"{type(failure).__name__}: {failure}"
        finally:
            if source is not None:
                source.close()

    def size_of(row: tuple) -> int:
        return ROW_BYTES + (row[1].nbytes if keep_values and row[1] is not None else 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in in_batches(fetched(batch), size_of, BATCH_BYTES):
                place, values, errors = zip(*rows)
                part = batch.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values, kind), pa.array(errors, pa.string())],
                    [*part.schema.names, value, "error"],
                )

    dealt = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    sql = "array<double>" if keep_values else "double"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return dealt.mapInArrow(read, f"{fields}, {value} {sql}, error string")


def stale_files(wanted: DataFrame, index: MessageIndex, files: DataFrame) -> DataFrame:
    """``file, error``: files of ``wanted`` that are not as they were indexed, by ``files``, a scan."""
    known = index.ledger.files().select("file", "modified", "length")
    now = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")
    changed = known.join(now, ["file", "modified", "length"], "left_anti").select("file")
    here = wanted.select("file").distinct()
    return here.join(changed, "file", "left_semi").withColumn("error", F.lit("changed since it was indexed"))
