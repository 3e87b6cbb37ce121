"""Results that are whole or not there: a folder for each run, and a pointer that is written last.

``target/runs/<run>/...`` holds what a run wrote, ``target/_current-<number>`` is an empty file
whose highest number names the run that holds. Making one file is a single step on every Hadoop
file system, so a run that dies at any point leaves the former results as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from gridmill.sources.scratch import delete_folder

_POINTER = "_current-"


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """``number, run`` of all pointers, the newest last."""
    path, files = _file_system(spark, target)
    found = files.globStatus(path(target, _POINTER + "*")) or []
    names = [f.getPath().getName().removeprefix(_POINTER) for f in found]
    return sorted((int(number), run) for number, _, run in (name.partition("-") for name in names))


def new_run(target: str) -> tuple[str, str]:
    """The name of a run, and the folder that it writes to."""
    run = uuid.uuid4().hex
    return run, f"{target.rstrip('/')}/runs/{run}"


def publish(spark: SparkSession, target: str, run: str, keep: int = 1) -> None:
    """Make ``run`` the one that readers see. ``keep`` former runs stay for those who read them
    still; older ones go, and what runs have left that never came to their end. So one job at a
    time writes into a target."""
    path, files = _file_system(spark, target)
    former = _pointers(spark, target)
    number = former[-1][0] + 1 if former else 1
    pointer = path(target, f"{_POINTER}{number}-{run}")
    if not files.createNewFile(pointer):
        raise FileExistsError(f"another run was published into {target} at the same time")
    held = {name for _, name in former[len(former) - keep :]} | {run}
    for old_number, name in former:
        if name not in held:
            files.delete(path(target, f"{_POINTER}{old_number}-{name}"), False)
    for folder in files.globStatus(path(target, "runs/*")) or []:
        if folder.getPath().getName() not in held:
            delete_folder(spark, folder.getPath().toString())


def current_run(spark: SparkSession, target: str) -> str | None:
    """The folder of the run that holds, or None before the first."""
    found = _pointers(spark, target)
    return f"{target.rstrip('/')}/runs/{found[-1][1]}" if found else None


def followed(spark: SparkSession, path: str) -> str:
    """``path`` itself, or where a pointer in the path or in a folder above it leads: of
    ``target/monthly`` the ``monthly`` of the run that holds."""
    head, tail = path.rstrip("/"), ""
    while head and not head.endswith(":"):
        run = current_run(spark, head)
        if run is not None:
            return run + tail
        parent, _, name = head.rpartition("/")
        if not parent or parent.endswith("/"):
            return path
        head, tail = parent, f"/{name}{tail}"
    return path
