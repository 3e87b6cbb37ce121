"""Message files through ``spark.read.format``."""

import sys
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridmill.sources.datasource import PUSHDOWN, MessageReader, _stamp, listed, register_source
from gridmill.sources import decode_files, describe
from helpers import rows

# Workers get what is defined here by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decoder(log=None):
    def decode(path, start, end):
        with open(path, "rb") as lines:
            if start:
                lines.seek(start - 1)
                lines.readline()
            while (offset := lines.tell()) < end and (line := lines.readline()):
                description, numbers = line.decode().split("|")

                def grid(numbers=numbers, path=path):
                    if log is not None:
                        with open(log, "a") as out:
                            out.write(path + "\n")
                    return [float(n) for n in numbers.split(",")]

                yield offset, description, grid

    return decode


def plain(path, start, end):
    for offset, description, grid in decoder()(path, start, end):
        yield offset, description, grid()


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    for year in (1999, 2000):
        (source / f"y={year}").mkdir(parents=True)
        (source / f"y={year}" / f"{year}.txt").write_text("".join(
            f"{i}:{'ab'[i % 2]}:x:from {year}01{1 + i % 28:02}0600|{i},{i + 2}\n" for i in range(500)
        ))
    (source / "odd.txt").write_text("no fields|1\n1:a:x:from 20009901|2\n")
    (source / "empty.txt").write_text("")
    (source / "_hidden.txt").write_text("x|1\n")
    (source / "other.dat").write_text("x|1\n")
    return str(source)


def load(spark, folder, own, pushdown=False, **options):
    name = register_source(spark, "grid_messages", own, pushdown)
    return spark.read.format(name).options(glob="*.txt", **options).load(folder)


def test_same_rows_as_the_scan(spark, folder):
    got = load(spark, folder, decoder(), range_bytes=1000)
    columns = ["file", "offset", "description", "name", "year", "valid_time", "grid_mean"]
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.txt").load(folder)
    want = describe(decode_files(files, plain, "range", range_bytes=1000)).withColumnRenamed("msg_no", "offset")
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert got.count() == 1002 and got.rdd.getNumPartitions() > 20


def test_pushed_filters(spark, folder, tmp_path):
    """With a DataFrame for each query, as Spark keeps with it what was pushed."""
    log = tmp_path / "log"
    spark.conf.set(PUSHDOWN, "true")
    try:
        def df():
            return load(spark, folder, decoder(str(log)), pushdown=True, range_bytes=1000)

        chosen = df().where("name = 'a' and year >= 2000 and grid_mean > 400")
        got = chosen.collect()
        assert len(got) == 50 and {r["name"] for r in got} == {"a"}
        # Only the grids of the messages that pass were decoded; the file with odd lines has none.
        assert len(log.read_text().splitlines()) == 250
        left = chosen._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("\n")[0]
        assert "> 400.0" in left and "= a" not in left and "2000" not in left
        one = df().where(F.col("file").endswith("1999.txt"))
        assert one.rdd.getNumPartitions() < df().rdd.getNumPartitions() / 2 + 1 and one.count() == 500
        assert df().where("name in ('b', 'c') and year < 2000").count() == 250
        assert df().where("name like 'a%' or year = 1999").count() == 751
    finally:
        spark.conf.unset(PUSHDOWN)


def test_one_frame_for_many_queries(spark, folder):
    df = load(spark, folder, decoder(), range_bytes=1000)
    assert df.where("name = 'a'").count() == 501 and df.count() == 1002
    assert df.where("year = 1999").count() == 500 and df.where("name like 'a%' or year = 1999").count() == 751


def test_options(spark, folder, tmp_path):
    log = tmp_path / "log"
    df = load(spark, folder, decoder(str(log)), names='["b", "no fields"]', years="1999-2000")
    assert df.count() == 500 and {r["name"] for r in df.collect()} == {"b"}
    assert len(log.read_text().splitlines()) == 1000
    assert load(spark, folder, decoder(), years="2000").count() == 500


def test_listing(folder, tmp_path):
    names = [f.rsplit("/", 1)[1] for f, _ in listed(folder, "*.txt")]
    assert names == ["odd.txt", "1999.txt", "2000.txt"]
    assert [f for f, _ in listed(folder + "/odd.txt", "*")] == ["file:" + folder + "/odd.txt"]
    assert listed("file://" + folder, "*.txt") == listed(folder, "*.txt")
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "none"), "*")


def test_errors_and_nothing(spark, folder, tmp_path):
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none"), decoder()).collect() == []

    def broken(path, start, end):
        raise ValueError("broken codec")
        yield

    with pytest.raises(Exception, match="broken codec"):
        load(spark, folder, broken).collect()


def test_many_small_ranges_share_tasks(spark, folder):
    """As many partitions at most as are worth their start; they hold all ranges once."""
    reader = MessageReader(folder, "*.txt", 10, decoder())
    parts = reader.partitions()
    ranges = [r for part in parts for r in part.ranges]
    sizes = dict(listed(folder, "*.txt"))
    assert len(parts) == 1000 < len(ranges) == sum(-(-size // 10) for size in sizes.values())
    assert sum(end - start for _, start, end in ranges) == sum(sizes.values()) and len(set(ranges)) == len(ranges)
    found = [row for part in parts for batch in reader.read(part) for row in batch.column("offset").to_pylist()]
    assert len(found) == 1002
    counts = {len(part.ranges) for part in parts}
    assert max(counts) - min(counts) <= 1


def test_stamps_of_the_source_and_the_functions(spark):
    texts = ["1:a:199602290000", "1:a:199702290000", "1:a:from 200013010000", "a", 
             "1:a:200001012400", "1:a:199912312359", "1:a:x99912312359"]
    rows_of = spark.createDataFrame([(t,) for t in texts], "description string")
    want = {r["description"]: (r["name"], r["year"], r["valid_time"]) for r in describe(rows_of).collect()}
    assert {t: _stamp(t) for t in texts} == want
