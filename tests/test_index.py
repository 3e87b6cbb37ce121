"""The message index: what it holds, and that reads fetch only the ranges asked for."""

import sys
import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridmill.operators import value_at
from gridmill.plans import run
from gridmill.sources import (
    Limits,
    MessageIndex,
    describe,
    decode_files,
    index_files,
    read_messages,
    scan_files,
    stale_files,
)
from helpers import rows

# Workers get what is defined here by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = ["t", "u", "v"]


def line(i, day, hour, name, points=50):
    values = ",".join(str(i * 1000 + k) for k in range(points))
    return f"{i}:{name}:surface:from {day:%Y%m%d}{hour:02}00|{values}\n"


def write(folder, name, year, days=40, steps=4):
    lines, start = [], dt.date(year, 1, 1)
    for d in range(days):
        for step in range(steps):
            for variable in NAMES:
                lines.append(line(len(lines), start + dt.timedelta(days=d), step * 6, variable))
    (folder / name).write_text("".join(lines))
    return len(lines)


def indexer(path):
    offset = 0
    with open(path, "rb") as file:
        for text in file:
            if text.startswith(b"bad"):
                raise OSError("broken header")
            yield offset, len(text), text.split(b"|")[0].decode()
            offset += len(text)


def content_indexer(content):
    offset = 0
    for text in bytes(content).splitlines(keepends=True):
        yield offset, len(text), text.split(b"|")[0].decode()
        offset += len(text)


def range_indexer(path, start, end):
    with open(path, "rb") as file:
        if start:
            file.seek(start - 1)
            file.readline()
        while (offset := file.tell()) < end and (text := file.readline()):
            yield offset, len(text), text.split(b"|")[0].decode()


def message(data):
    return [float(v) for v in bytes(data).decode().split("|")[1].split(",")]


def whole_decoder(content):
    for text in bytes(content).decode().splitlines():
        description, values = text.split("|")
        yield description, [float(v) for v in values.split(",")]


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.txt", 1999)
    write(source, "b.txt", 2000)
    return source


def counted_opener(log):
    """Writes down each read of a file."""

    class Counted:
        def __init__(self, uri):
            self.file = open(uri.removeprefix("file:"), "rb")

        def seek(self, place):
            self.place = place
            self.file.seek(place)

        def read(self, size):
            with open(log, "a") as out:
                out.write(f"{os.path.basename(self.file.name)} {self.place} {size}\n")
            return self.file.read(size)

        def close(self):
            self.file.close()

    return Counted


def reads(log):
    return [(f, int(a), int(b)) for f, a, b in (r.split() for r in open(log).read().splitlines())]


@pytest.mark.parametrize("by, own", [("path", indexer), ("content", content_indexer), ("range", range_indexer)])
def test_index_rows(spark, folder, by, own):
    files = scan_files(spark, str(folder), "*.txt")
    got = index_files(files, own, by, range_bytes=5000, limits=Limits()).collect()
    assert len(got) == 960 and not any(r["error"] for r in got)
    for r in got:
        with open(r["file"].removeprefix("file:"), "rb") as file:
            file.seek(r["offset"])
            text = file.read(r["length"]).decode()
        assert text.endswith("\n") and text.startswith(r["description"] + "|")
        assert by == "range" or int(text.split(":")[0]) == r["msg_no"]


def test_reads_only_what_is_asked_for(spark, folder, tmp_path):
    files = scan_files(spark, str(folder), "*.txt")
    index = MessageIndex(spark, str(tmp_path / "index"))
    assert tuple(index.refresh(files, indexer)) == (2, 0, 0)
    log = str(tmp_path / "reads")
    at = dt.datetime(2000, 2, 1, 6)
    wanted = index.messages(at=at)
    got = read_messages(wanted, message, opener=counted_opener(log)).collect()
    whole = value_at(describe(decode_files(files, whole_decoder)), at.date(), at.hour)
    assert sorted((r["name"], r["grid_mean"]) for r in got) == sorted((r["name"], r["grid_mean"]) for r in whole.collect())
    assert [r["name"] for r in sorted(got, key=lambda r: r["msg_no"])] == NAMES
    # Three messages that follow each other: one read of their bytes in one of the files.
    places = sorted((r["offset"], r["length"]) for r in got)
    assert reads(log) == [("b.txt", places[0][0], sum(n for _, n in places))]

    other = str(tmp_path / "reads of a variable")
    index_rows = index.messages(names=["u"]).where("year = 1999")
    got = read_messages(index_rows, message, opener=counted_opener(other), gap_bytes=0).collect()
    assert len(got) == 160 and {r["name"] for r in got} == {"u"}
    assert sorted(reads(other)) == sorted(("a.txt", r["offset"], r["length"]) for r in got)
    # With gaps read along, the same messages in fewer reads of bounded size.
    fewer = str(tmp_path / "fewer")
    again = read_messages(index_rows, message, opener=counted_opener(fewer), fetch_bytes=10_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert 1 < len(reads(fewer)) < 40 and max(n for *_, n in reads(fewer)) <= 10_000


def test_filters_reach_the_stored_index(spark, folder, tmp_path, capsys):
    index = MessageIndex(spark, str(tmp_path / "index"))
    index.refresh(scan_files(spark, str(folder), "*.txt"), indexer)
    index.messages(names=["u"], at=dt.datetime(2000, 1, 2, 6)).explain("formatted")
    pushed = [p for p in capsys.readouterr().out.splitlines() if p.startswith("PushedFilters") and "valid_time" in p]
    assert pushed and "GreaterThanOrEqual(valid_time" in pushed[0] and "EqualTo(name,u)" in pushed[0]


def test_many_tasks_read_one_file(spark, folder, tmp_path):
    index = MessageIndex(spark, str(tmp_path / "index"))
    index.refresh(scan_files(spark, str(folder), "*.txt"), indexer)
    wanted = index.messages().where("year = 1999")
    df = read_messages(wanted, message, task_bytes=20_000)
    assert df.rdd.getNumPartitions() > 3
    grids = read_messages(wanted, message, keep_values=True, task_bytes=20_000).collect()
    assert len(grids) == 480 and all(len(r["values"]) == 50 for r in grids)
    means = {r["msg_no"]: r["grid_mean"] for r in df.collect()}
    assert all(means[r["msg_no"]] == np.mean(r["values"]) for r in grids)


def test_refresh_sees_changes(spark, folder, tmp_path):
    index = MessageIndex(spark, str(tmp_path / "index"))
    index.refresh(scan_files(spark, str(folder), "*.txt"), indexer)
    write(folder, "a.txt", 1999, days=3)
    write(folder, "c.txt", 2001, days=2)
    (folder / "bad.txt").write_text(line(0, dt.date(1990, 1, 1), 0, "t") + "bad header\n")
    (folder / "b.txt").unlink()
    files = scan_files(spark, str(folder), "*.txt")
    old = index.messages()
    assert {r["file"].rsplit("/", 1)[1] for r in stale_files(old, index, files).collect()} == {"a.txt", "b.txt"}
    assert tuple(index.refresh(files, indexer)) == (3, 0, 1)
    found = {(r["file"].rsplit("/", 1)[1], r["n"]) for r in index.messages().groupBy("file").count().withColumnRenamed("count", "n").collect()}
    assert found == {("a.txt", 36), ("c.txt", 24)}
    assert [(r["file"].rsplit("/", 1)[1], r["error"]) for r in index.bad_files().collect()] == [("bad.txt", "OSError: broken header")]
    # Nothing has changed: nothing is indexed, and the stored state stays as it is.
    before = sorted(os.listdir(tmp_path / "index"))
    assert tuple(index.refresh(files, lambda path: 1 / 0)) == (0, 3, 0)
    assert sorted(os.listdir(tmp_path / "index")) == before


def test_bad_reads_are_rows(spark, folder, tmp_path):
    index = MessageIndex(spark, str(tmp_path / "index"))
    index.refresh(scan_files(spark, str(folder), "*.txt"), indexer)
    wanted = index.messages(names=["t"])
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_text("\n".join(["short"] * 40))
    got = read_messages(wanted, message).collect()
    assert len(got) == 320 and all(r["grid_mean"] is None and r["error"] for r in got)
    assert {r["error"].split(":")[0] for r in got if r["file"].endswith("a.txt")} == {"FileNotFoundError"}
    assert "EOFError" in {r["error"].split(":")[0] for r in got if r["file"].endswith("b.txt")}


def test_index_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    index = MessageIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="refresh"):
        index.messages()
    (tmp_path / "in" / "a.txt").write_text("")
    assert rows(read_messages(index_with_one(spark, tmp_path, index).where("false"), message)) == []


def index_with_one(spark, tmp_path, index):
    write(tmp_path / "in", "b.txt", 2000, days=1)
    index.refresh(scan_files(spark, str(tmp_path / "in"), "*.txt"), indexer)
    return index.messages()


def test_run_by_index(spark, folder, tmp_path, monkeypatch):
    """The job of one variable and of one hour: the same tables from their ranges alone."""
    log = str(tmp_path / "log")

    def counted(data):
        with open(log, "a") as out:
            out.write("x")
        return message(data)

    (folder / "empty.txt").write_text("")
    at = dt.datetime(2000, 2, 1, 6)
    settings = dict(variables=["u"], glob="*.txt", at=at)
    by_index = run(
        spark, str(folder), str(tmp_path / "by index"), counted, index=str(tmp_path / "index"),
        indexer=indexer, **settings,
    )
    # Of 960 messages those of the variable, and once more that of the hour.
    assert len(open(log).read()) == 320 + 1
    whole = run(spark, str(folder), str(tmp_path / "whole"), whole_decoder, **settings)
    columns = ["year", "month", "name", "value"]
    assert rows(by_index.monthly.select(columns)) == rows(whole.monthly.select(columns))
    assert rows(by_index.series) == rows(whole.series)
    assert [r["error"] for r in by_index.bad_files.collect()] == ["file of zero bytes"]
    values = spark.read.option("header", True).csv(str(tmp_path / "by index" / "values"))
    assert [(r["name"], float(r["grid_mean"])) for r in values.collect()] == [
        (r["name"], r["grid_mean"]) for r in value_at(describe(decode_files(
            scan_files(spark, str(folder), "b.txt"), whole_decoder)), at.date(), at.hour).where("name = 'u'").collect()
    ]
    with pytest.raises(ValueError, match="time mode"):
        run(spark, str(folder), str(tmp_path / "x"), message, mode="position", index="i", indexer=indexer)
    by_index.release()
    whole.release()


def test_many_small_messages(spark, tmp_path):
    """The cost of a message does not grow with those that are fetched along with it, and tasks get
    a bounded number of messages, however short they are."""
    count = 40_000
    lines = "".join(f"{i}:a:from 200001010000|{i}\n" for i in range(count))
    (tmp_path / "a.txt").write_text(lines)
    offsets = np.cumsum([0] + [len(line) + 1 for line in lines.splitlines()]).tolist()
    rows = [
        (str(tmp_path / "a.txt"), i, offsets[i], offsets[i + 1] - offsets[i], "a", 2000, dt.datetime(2000, 1, 1))
        for i in range(count)
    ]
    schema = "file string, msg_no bigint, offset bigint, length bigint, name string, year int, valid_time timestamp_ntz"
    wanted = spark.createDataFrame(rows, schema).repartition(1)

    def number(data):
        return [float(bytes(data).split(b"|")[1])]

    began = time.monotonic()
    got = read_messages(wanted, number).agg(F.count("*"), F.sum("grid_mean"), F.count("error")).first()
    assert tuple(got) == (count, count * (count - 1) / 2, 0)
    assert time.monotonic() - began < 10
    many = read_messages(spark.range(100 * count).selectExpr(
        "'x' as file", "id as msg_no", "id as offset", "1l as length", "'a' as name", "2000 as year",
        "timestamp_ntz'2000-01-01' as valid_time",
    ), number)
    assert many.rdd.getNumPartitions() == 40
