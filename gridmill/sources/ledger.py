"""Rows derived from files, kept up to date file by file.

A ledger is a folder with one published run for each update. A run holds the rows of the files that
were new or changed then, and the list of all files that hold now, each with the run that has its
rows. So an update derives rows of what has changed only, writes nothing again that is there, and
a file that was withdrawn or replaced drops out of the list and with it its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.published import current_run, new_run, publish
from gridmill.sources.scratch import delete_folder

_FILES = "file string, modified timestamp, length bigint, run string"
#: Runs whose rows are held before they are written together.
MOST_RUNS = 20


class Change(NamedTuple):
    """Files of an update: ``decoded`` are the new and changed ones, ``withdrawn`` those that the
    listing no longer has."""

    decoded: int
    kept: int
    withdrawn: int


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A scan of just these files, which are names and no patterns."""
    plain = [re.sub(r"([\\*?\[\]{},])", r"\\\1", path) for path in paths]
    return spark.read.format("binaryFile").load(plain)


class FileLedger:
    """The rows of a set of files under ``path``, any Hadoop URI. One writer at a time: two
    updates that end together would publish two states, and the second one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def files(self) -> DataFrame:
        """``file, modified, length, run``: the files that the ledger holds."""
        run = current_run(self.spark, self.path)
        if run is None:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).parquet(f"{run}/files")

    def runs(self) -> list[str]:
        """The runs whose rows are held; ``MOST_RUNS`` at most."""
        return sorted(r[0] for r in self.files().select("run").distinct().collect())

    def rows(self) -> DataFrame | None:
        """The rows of all files that the ledger holds; None if it never held any. Each has the
        column ``file``."""
        return self._rows_of(self.files())

    def _rows_of(self, files: DataFrame) -> DataFrame | None:
        runs = sorted(r[0] for r in files.select("run").distinct().collect())
        tables = []
        for run in runs:
            rows = self.spark.read.parquet(f"{self.path}/rows/{run}")
            # Most runs lose a file now and then: those that hold are few words each.
            held = files.where(F.col("run") == run).select("file")
            tables.append(rows.join(held, "file", "left_semi").select(rows.columns))
        while len(tables) > 1:
            # Pairwise, so that the plan is as deep as the logarithm of their number.
            pairs = [tables[i : i + 2] for i in range(0, len(tables), 2)]
            tables = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
        return tables[0] if tables else None

    def update(self, listing: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> Change:
        """Bring the ledger up to date with ``listing``, a scan of all files. ``derive`` turns a scan
        of the files that are new or have another length or time of change into rows with
        ``file``, the path of each; it is not called where nothing has changed.

        An update that dies leaves the ledger as it was, and the next one does its work. Names of
        the changed files go through the driver, which has the listing anyway.
        """
        now = listing.select(
            F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length"
        )
        held, first = self.files(), current_run(self.spark, self.path) is None
        same = ["file", "modified", "length"]
        changed = now if first else now.join(held.select(same), same, "left_anti")
        kept = held.join(now, same, "left_semi").select(held.columns)
        names = [] if first else [r[0] for r in changed.select("file").collect()]
        change = Change(
            now.count() if first else len(names),
            kept.count(),
            held.join(now.select("file"), "file", "left_anti").count(),
        )
        if not first and not change.decoded and not change.withdrawn:
            return change
        run, folder = new_run(self.path)
        if change.decoded:
            derived = derive(listing if first else load_files(self.spark, names))
            derived.write.parquet(f"{self.path}/rows/{run}")
        every = kept.unionByName(changed.withColumn("run", F.lit(run)))
        every.write.parquet(f"{folder}/files")
        written = self.spark.read.schema(_FILES).parquet(f"{folder}/files")
        if written.select("run").distinct().count() > MOST_RUNS:
            run = self._together(written)
        publish(self.spark, self.path, run)
        self._drop_unused()
        return change

    def _together(self, files: DataFrame) -> str:
        """All rows as those of one run."""
        run, folder = new_run(self.path)
        self._rows_of(files).write.parquet(f"{self.path}/rows/{run}")
        files.withColumn("run", F.lit(run)).write.parquet(f"{folder}/files")
        return run

    def _drop_unused(self) -> None:
        """Rows of runs that no file of this state and of the one before names any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        states = [f.getPath() for f in files.globStatus(path(self.path, "runs/*/files")) or []]
        named = set()
        for state in states:
            table = self.spark.read.schema(_FILES).parquet(state.toString())
            named |= {r[0] for r in table.select("run").distinct().collect()}
        for folder in files.globStatus(path(self.path, "rows/*")) or []:
            if folder.getPath().getName() not in named:
                delete_folder(self.spark, folder.getPath().toString())
