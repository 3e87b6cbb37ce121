"""Intermediate tables in a folder that all executors share.

A table written there survives the loss of executors, cuts the lineage, and gives Catalyst the
true size of what it joins: below ``spark.sql.autoBroadcastJoinThreshold`` it broadcasts, above
it sorts and merges, and adaptive execution splits the skewed partitions. So no join in this
library carries a broadcast hint that would grow with the data.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_folder: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one in the session's
    warehouse, if executors share it as well: on a cluster it must not be a folder of one machine,
    where each executor would write to a disk of its own and later reads would miss those files."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        scheme = urlsplit(warehouse).scheme or "file"
        if scheme == "file" and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that all executors share; {warehouse} is one of this machine")
        root = warehouse.rstrip("/") + "/_scratch"
    return root.rstrip("/")


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/gridmill-{spark.sparkContext.applicationId}"


@contextmanager
def scratch_in(folder: str) -> Iterator[str]:
    """Within this block, scratch tables of this thread go to ``folder``. Whoever opens it deletes
    it, with ``delete_folder``, once nothing reads its tables any more."""
    token = _folder.set(folder.rstrip("/"))
    try:
        yield folder
    finally:
        _folder.reset(token)


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path in the folder of ``scratch_in``, or of this application."""
    return f"{_folder.get() or _app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Run ``df`` once into a scratch Parquet table and return the table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application but for those of ``scratch_in``; call it
    when their readers are done."""
    delete_folder(spark, _app_folder(spark))
