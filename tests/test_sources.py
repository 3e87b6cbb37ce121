import json
import math
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill import sources as src
from gridmill.functions import grid_mean
from gridmill.operators import number_messages
from gridmill.session import session
from gridmill.sources import scratch
from gridmill.sources import files
from gridmill.sources.files import in_batches
from helpers import rows
from workload import views

NAN = math.nan


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


# --- message files ------------------------------------------------------------------------


def json_decoder():
    def decode(content):
        for line in bytes(content).decode().splitlines():
            message = json.loads(line)
            yield message["d"], message["v"]

    return decode


def path_decoder():
    def decode(path):
        with open(path) as lines:
            for line in lines:
                message = json.loads(line)
                yield message["d"], message["v"]

    return decode


@pytest.fixture
def toy_files(tmp_path):
    folder = tmp_path / "in put"
    good = [json.dumps({"d": f"{i}:{'ab'[i % 2]}:x:20000101{i:02}00", "v": [i, i + 2]}) for i in range(5)]
    put(folder, "1.grib", "\n".join(good))
    put(folder, "2.grib", good[0] + "\n" + good[1] + "\nnot a message\n" + good[2])
    put(folder, "3.grib", "\n")
    put(folder, "x.txt", "something else")
    return str(folder)


def base(df):
    return df.withColumn("file", F.substring_index("file", "/", -1))


def test_scan_files_by_glob(spark, toy_files):
    files = src.scan_files(spark, toy_files)
    assert files.columns == ["path", "modificationTime", "length", "content"]
    names = {r.path.rsplit("/", 1)[-1]: r.length for r in files.select("path", "length").collect()}
    assert set(names) == {"1.grib", "2.grib", "3.grib"} and names["3.grib"] == 1
    assert src.scan_files(spark, toy_files, "*.txt").count() == 1


@pytest.mark.parametrize(("by", "decoder"), [("content", json_decoder()), ("path", path_decoder())])
@pytest.mark.parametrize("batch_bytes", [600, 10**6])
def test_decode_numbers_messages_and_reports_bad_files(spark, toy_files, by, decoder, batch_bytes):
    decoded = src.decode_files(src.scan_files(spark, toy_files), decoder, by, batch_bytes=batch_bytes)
    good, bad = src.split_decoded(decoded)
    got = rows(base(good).select("file", "msg_no", "grid_mean"))
    assert got == [("1.grib", i, i + 1.0) for i in range(5)]
    report = {r.file: r.error for r in base(bad).collect()}
    assert set(report) == {"2.grib", "3.grib"} and "JSONDecodeError" in report["2.grib"]


def range_decoder():
    """Lines that begin in [start, end), with their offsets."""

    def decode(path, start, end):
        with open(path, "rb") as lines:
            if start:
                lines.seek(start - 1)
                lines.readline()
            while (offset := lines.tell()) < end and (line := lines.readline()):
                message = json.loads(line)
                yield offset, message["d"], message["v"]

    return decode


@pytest.mark.parametrize("range_bytes", [7, 60, 10**6])
def test_ranges_of_a_file_give_each_message_once(spark, toy_files, range_bytes):
    files = src.scan_files(spark, toy_files)
    decoded = src.decode_files(files, range_decoder(), by="range", range_bytes=range_bytes)
    good, bad = src.split_decoded(decoded)
    assert {r.file for r in base(bad).collect()} == {"2.grib", "3.grib"}
    numbered = number_messages(good.withColumnRenamed("msg_no", "offset"), ["offset"])
    got = rows(base(numbered).select("file", "msg_no", "grid_mean"))
    assert got == [("1.grib", i, i + 1.0) for i in range(5)]


def test_one_file_is_decoded_by_many_tasks(spark, tmp_path):
    line = json.dumps({"d": "0:a:200001010000", "v": [1]}) + "\n"
    put(tmp_path, "1.grib", line * 400)
    files = src.scan_files(spark, str(tmp_path))
    ranges = src.split_files(files, len(line) * 10)
    assert ranges.count() == 40
    used = ranges.withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert used > 20
    assert src.decode_files(files, range_decoder(), "range", range_bytes=len(line) * 10).count() == 400


def test_a_file_without_messages_is_reported(spark, tmp_path):
    put(tmp_path, "1.grib", "x")
    good, bad = src.split_decoded(src.decode_files(src.scan_files(spark, str(tmp_path)), lambda _: []))
    assert good.count() == 0 and [r.error for r in bad.collect()] == ["ValueError: no messages"]


def test_silent_files_are_reported(spark, tmp_path):
    """Zero bytes, nothing in any range, and too long to be read as content."""
    put(tmp_path, "1.grib", json.dumps({"d": "0:a:200001010000", "v": [1]}))
    put(tmp_path, "2 empty.grib", "")
    put(tmp_path, "3.grib", "\n" * 3000)
    files = src.scan_files(spark, str(tmp_path))
    lines = range_decoder()

    def silent(path, start, end):
        if path.endswith("1.grib"):
            yield from lines(path, start, end)

    decoded = src.decode_files(files, silent, by="range", range_bytes=1000)
    good, bad = src.split_decoded(decoded, files, "range")
    report = {os.path.basename(r.file).replace("%20", " "): r.error for r in bad.collect()}
    assert good.count() == 1 and report == {"2 empty.grib": "file of zero bytes", "3.grib": "no messages"}

    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")
    try:
        decoded = src.decode_files(files, json_decoder())
        good, bad = src.split_decoded(decoded, files, "content")
        report = {os.path.basename(r.file).replace("%20", " "): r.error for r in bad.collect()}
        assert good.count() == 1 and set(report) == {"2 empty.grib", "3.grib"}
        assert "use path or range" in report["3.grib"]
    finally:
        spark.conf.unset(limit)


def test_each_range_is_a_partition_of_its_own(spark, tmp_path):
    put(tmp_path, "1.grib", "x" * 5000)
    put(tmp_path, "2.grib", "x" * 1234)
    ranges = src.split_files(src.scan_files(spark, str(tmp_path)), 10)
    sizes = ranges.groupBy(F.spark_partition_id()).count().collect()
    assert ranges.rdd.getNumPartitions() == len(sizes) == 500 + 124 and {r["count"] for r in sizes} == {1}


def test_many_small_ranges_share_tasks(spark, tmp_path):
    """Tasks do not grow with the number of small ranges; each gets as many that follow each other."""
    put(tmp_path, "1.grib", "x" * 4000)
    put(tmp_path, "2.grib", "x" * 1234)
    ranges = src.split_files(src.scan_files(spark, str(tmp_path)), 2)
    dealt = ranges.withColumn("task", F.spark_partition_id()).collect()
    assert ranges.rdd.getNumPartitions() == 1000
    assert sorted(r["start"] for r in dealt if r["path"].endswith("1.grib")) == list(range(0, 4000, 2))
    assert len(dealt) == 2000 + 617 and all(r["end"] == r["start"] + 2 for r in dealt)
    held = {}
    for r in dealt:
        held.setdefault(r["task"], []).append((r["path"], r["start"]))
    assert {len(places) for places in held.values()} == {2, 3}
    turns = [place for task in sorted(held) for place in sorted(held[task])]
    assert turns == sorted(turns)


def test_decoding_holds_few_rows():
    """A task holds some ten thousand messages, and the decoder of text some of a file's lines."""
    assert files.BATCH_BYTES // files.ROW_BYTES <= 50_000
    lines = b"".join(b"%d:a:level 0:from 200001010000|%d,2\n" % (i, i) for i in range(300_000))
    tracemalloc.start()
    try:
        total = sum(grid[0] for _, grid in views.line_decoder()(memoryview(lines)))
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()
    assert total == 300_000 * 299_999 / 2
    # Lines across the borders of the pieces, and a last one without an end.
    odd = ("é" * 700_000 + "\n\n" + "x" * 3_000_000 + "\nlast").encode()
    assert list(views._lines(odd)) == odd.decode().splitlines()


def test_batches_keep_to_their_bytes():
    sizes = [3, 4, 2, 9, 40, 1, 5, 5]
    lists = list(in_batches([(n,) for n in sizes], lambda row: row[0], 10))
    assert [n for rows in lists for (n,) in rows] == sizes
    assert all(sum(n for (n,) in rows) <= 10 or len(rows) == 1 for rows in lists) and len(lists) == 5


def test_path_mode_reads_no_content(spark, toy_files):
    decoded = src.decode_files(src.scan_files(spark, toy_files), path_decoder(), by="path")
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    with pytest.raises(ValueError, match="by must be"):
        src.decode_files(src.scan_files(spark, toy_files), path_decoder(), by="name")


def test_describe(spark, toy_files):
    good, _ = src.split_decoded(src.decode_files(src.scan_files(spark, toy_files), json_decoder()))
    got = src.describe(good).orderBy("msg_no").first()
    assert (got.name, got.year, str(got.valid_time)) == ("a", 2000, "2000-01-01 00:00:00")


def test_grids_masked_nan_and_empty(spark, tmp_path):
    put(tmp_path, "1.grib", "x")

    def decode(_):
        yield "masked", np.ma.masked_array([[1.0, 2.0], [9.0, 5.0]], [[0, 0], [1, 0]])
        yield "masked ints", np.ma.masked_array([1, 3, 100], [0, 0, 1])
        yield "nan", np.array([1.0, NAN, 4.0])
        yield "single", np.full(10**5, 0.1, dtype="float32")
        yield "all masked", np.ma.masked_array([1.0], [1])
        yield "empty", np.array([])
        yield "list", [1, 2]

    expected = {"masked": 8 / 3, "masked ints": 2.0, "nan": 2.5, "single": float(np.float32(0.1)),
                "all masked": None, "empty": None, "list": 1.5}
    files = src.scan_files(spark, str(tmp_path))
    means = {r.description: r.grid_mean for r in src.decode_files(files, decode).collect()}
    whole = src.decode_files(files, decode, keep_values=True)
    reduced = {
        r.description: r.m
        for r in whole.select("description", grid_mean(F.col("values")).alias("m")).collect()
    }
    for got in (means, reduced):
        assert got.keys() == expected.keys()
        for key, value in expected.items():
            assert got[key] == (None if value is None else pytest.approx(value, rel=1e-12)), key


# --- CSV tables ---------------------------------------------------------------------------


@pytest.fixture
def nan_csv(tmp_path):
    put(tmp_path, "2000.csv", "Month,a,b b\nJan,1.5,nan\nFeb,nan,10.0\nMar,9.0,2.0\n")
    put(tmp_path, "2001.csv", "Month,a,b b\nJan,NaN,3.0\n")
    put(tmp_path, "summary_data.csv", "Year,a_min,a_max\n2000,1.5,9.0\n")
    return str(tmp_path)


def test_text_nan_is_a_number(spark, nan_csv):
    table = src.scan_monthly_csv(spark, nan_csv, ["a", "b b"], glob="2*.csv")
    assert dict(table.dtypes) == {"Month": "string", "a": "double", "b b": "double", "year": "int"}
    got = {(r.year, r.Month): (r.a, r["b b"]) for r in table.collect()}
    assert got[2000, "Mar"] == (9.0, 2.0) and math.isnan(got[2000, "Feb"][0])
    assert math.isnan(got[2001, "Jan"][0]) and math.isnan(got[2000, "Jan"][1])
    assert table.agg(F.max(F.nanvl("b b", F.lit(0.0)))).first()[0] == 10.0


def test_summary_files_are_left_out(spark, nan_csv):
    table = src.scan_monthly_csv(spark, nan_csv, ["a", "b b"], exclude_prefix="summary_data")
    assert table.count() == 4 and {r.year for r in table.collect()} == {2000, 2001}
    cells = src.scan_monthly_cells(spark, nan_csv, exclude_prefix="summary_data")
    assert {r.file for r in cells.collect()} == {"2000.csv", "2001.csv"}


def test_files_without_a_year_get_null(spark, tmp_path):
    put(tmp_path, "notes.csv", "Month,a\nJan,1.0\n")
    put(tmp_path, "2000.csv", "Month,a\nJan,2.0\n")
    table = src.scan_monthly_csv(spark, str(tmp_path), ["a"])
    assert rows(table.select("year", "a")) == [(2000, 2.0), (None, 1.0)]


@pytest.fixture
def swapped_csv(tmp_path):
    put(tmp_path, "2000.csv", 'Month,b,"a, hot"\r\nJan,1.0,2.0\r\nFeb,3.0,\r\n')
    put(tmp_path, "2001.csv", 'Month,"a, hot",b,c\nJan,5.0,6.0,nan\n')
    return str(tmp_path)


def test_another_header_raises_in_the_typed_scan(spark, swapped_csv):
    with pytest.raises(Exception, match="header"):
        src.scan_monthly_csv(spark, swapped_csv, ["b", "a, hot"]).collect()


def test_cells_follow_the_header_of_their_file(spark, swapped_csv):
    cells = src.scan_monthly_cells(spark, swapped_csv)
    assert cells.columns == ["file", "year", "month", "name", "value"]
    got = {(r.year, r.month, r.name): r.value for r in cells.collect()}
    assert math.isnan(got.pop((2001, 1, "c")))
    assert got == {
        (2000, 1, "b"): 1.0, (2000, 1, "a, hot"): 2.0, (2000, 2, "b"): 3.0, (2000, 2, "a, hot"): None,
        (2001, 1, "a, hot"): 5.0, (2001, 1, "b"): 6.0,
    }


def test_cells_of_a_file_with_a_header_only(spark, tmp_path):
    put(tmp_path, "2000.csv", "Month,a\n")
    assert src.scan_monthly_cells(spark, str(tmp_path)).count() == 0


def test_wide_lines_are_parsed_once(spark, tmp_path):
    names = [f"v{i}" for i in range(3000)]
    put(tmp_path, "2000.csv", "\n".join(
        [",".join(["Month", *names])] + [",".join([m, *["1.5"] * 3000]) for m in ("Jan", "Feb", "Dec")]
    ))
    cells = src.scan_monthly_cells(spark, str(tmp_path))
    assert cells.groupBy("month").agg(F.sum("value")).collect().__len__() == 3
    assert cells.agg(F.sum("value")).first()[0] == 3 * 3000 * 1.5
    assert "from_csv" not in cells._jdf.queryExecution().toString()


def test_bad_cells_are_reported(spark, tmp_path):
    put(tmp_path, "2000.csv", 'Month,"a,""x""",b\nJan,1,oops\nFeb,nan,\nMoon,1,2\nMar,1,2,3\nApr,1')
    put(tmp_path, "notes.csv", "Month,a\nJan,1")
    os.makedirs(tmp_path / "year=1999")
    put(tmp_path / "year=1999", "part-0.csv", 'Month,"q\\"t"\nJan,4')
    cells = src.monthly_cells(spark, str(tmp_path))
    errors = sorted((r.file, r.error) for r in cells.where("error is not null").collect())
    assert errors == [
        ("2000.csv", "cell beyond the header: 3"), ("2000.csv", "not a number: oops"),
        ("notes.csv", "no year in its name"),
    ]
    good = {(r.year, r.month, r.name): r.value for r in cells.where("error is null").collect()}
    assert good[2000, 1, 'a,"x"'] == 1.0 and good[1999, 1, 'q"t'] == 4.0
    assert str(good[2000, 2, 'a,"x"']) == "nan" and good[2000, 2, "b"] is None
    assert good[2000, None, "b"] == 2.0 and good[2000, 3, "b"] == 2.0 and good[2000, 4, "b"] is None


def test_union_years(spark):
    one = spark.createDataFrame([(1.0, 2000)], "a double, year int")
    two = spark.createDataFrame([(2001, 2.0)], "year int, b double")
    both = src.union_years([one, two])
    assert both.columns == ["a", "year", "b"]
    assert rows(both) == [(1.0, 2000, None), (None, 2001, 2.0)]


# --- scratch ------------------------------------------------------------------------------


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert src.scratch_root(spark) == root and src.scratch_path(spark).startswith(root + "/gridmill-")


def test_scratch_unset(spark, monkeypatch):
    """The warehouse is shared as well."""
    monkeypatch.setattr(scratch, "_SETTING", "spark.gridmill.no.such.setting")
    assert src.scratch_root(spark) == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def test_scratch_of_a_block(spark, tmp_path):
    with src.scratch_in(str(tmp_path / "own")):
        table = src.materialize(spark.range(3))
    assert src.scratch_path(spark).startswith(src.scratch_root(spark))
    assert table.count() == 3 and os.listdir(tmp_path / "own")
    src.delete_folder(spark, str(tmp_path / "own"))
    assert not os.path.exists(tmp_path / "own")


def test_session_leaves_what_is_set(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Vienna")
    try:
        assert session("other").conf.get("spark.sql.session.timeZone") == "Europe/Vienna"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_materialize_runs_once(spark):
    df = spark.range(100).withColumn("r", F.rand())
    stored = src.materialize(df)
    assert stored.schema == df.schema or stored.columns == df.columns
    assert rows(stored) == rows(stored)
    assert "FileScan parquet" in stored._jdf.queryExecution().executedPlan().toString()


def test_unreadable_descriptions_are_errors_of_their_file(spark, tmp_path):
    put(tmp_path, "1.grib", json.dumps({"d": "0:a:200001010000", "v": [1]}))
    put(tmp_path, "2.grib", "\n".join(
        json.dumps({"d": d, "v": [1]}) for d in ("0:a:200001010000", "1:a:no time", "2:no time")
    ))
    decoded = src.describe(src.decode_files(src.scan_files(spark, str(tmp_path)), json_decoder()))
    good, bad = src.split_decoded(src.flag_unreadable(decoded, ["name", "valid_time"]))
    assert [r.file for r in base(good).collect()] == ["1.grib"]
    assert rows(base(bad)) == [("2.grib", "message without name or valid_time: number 1")]
    first = src.flag_unreadable(decoded, ["year"], first_message_only=True)
    assert src.split_decoded(first)[1].count() == 0


@pytest.mark.parametrize("tasks", [None, 3, 40])
def test_no_task_holds_more_than_the_longest_file_and_the_mean(spark, tmp_path, tasks):
    sizes = {f"{i}.txt": size for i, size in enumerate([3_000_000] + [20_000 * (1 + i % 9) for i in range(120)])}
    for name, size in sizes.items():
        put(tmp_path, name, "x" * size)
    dealt = src.deal_files(src.scan_files(spark, str(tmp_path), "*.txt"), tasks=tasks)
    held = {}
    for r in dealt.select("path", F.spark_partition_id().alias("task")).collect():
        held[r["task"]] = held.get(r["task"], 0) + sizes[r["path"].rsplit("/", 1)[1]]
    assert len(held) == dealt.rdd.getNumPartitions() == (tasks or 8)
    assert sum(held.values()) == sum(sizes.values())
    assert max(held.values()) <= max(sizes.values()) + sum(sizes.values()) / len(held)
    assert max(held.values()) - min(held.values()) <= max(sizes.values())


def test_a_thousand_tables_make_a_shallow_plan(spark):
    tables = [spark.range(1).selectExpr("id", f"id as c{i % 3}") for i in range(300)]
    united = src.union_years(tables)
    assert united.columns == ["id", "c0", "c1", "c2"] and united.count() == 300
    with pytest.raises(ValueError, match="no table"):
        src.union_years([])


def test_scratch_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_SETTING", "spark.no.such.setting")
    assert "_scratch" in src.scratch_root(spark)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    with pytest.raises(ValueError, match="all executors share"):
        src.scratch_root(Session())
