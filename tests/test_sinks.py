import os

from gridmill import operators as op
from gridmill import sinks
from gridmill import sources as src
from helpers import rows


def wide(spark, years, value=1.0):
    data = [(y, m, "v. one", value + m) for y in years for m in (12, 2, 1)]
    data += [(y, m, "two", value - m) for y in years for m in (1, 2)]
    monthly = spark.createDataFrame(data, "year int, month int, name string, value double")
    return op.monthly_wide(monthly, ["v. one", "two"])


def read(spark, path):
    return rows(src.scan_monthly_partitions(spark, path, ["v. one", "two"]))


def test_monthly_folders_are_replaced_by_year(spark, tmp_path):
    path = str(tmp_path / "new" / "monthly")
    sinks.write_monthly(wide(spark, [1999, 2000]), path)
    first = read(spark, path)
    assert len(first) == 6 and sorted(os.listdir(path))[-2:] == ["year=1999", "year=2000"]
    sinks.write_monthly(wide(spark, [1999, 2000]), path)
    assert read(spark, path) == first
    sinks.write_monthly(wide(spark, [2000], 50.0), path)
    again = read(spark, path)
    assert len(again) == 6
    assert {r[1] for r in again if r[3] == 1999} == {2.0, 3.0, 13.0}
    assert {r[1] for r in again if r[3] == 2000} == {51.0, 52.0, 62.0}


def test_monthly_read_prunes_folders(spark, tmp_path):
    path = str(tmp_path)
    sinks.write_monthly(wide(spark, [1999, 2000]), path)
    one = src.scan_monthly_partitions(spark, path, ["v. one", "two"]).where("year = 2000")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_year_files_as_text(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_year_files(wide(spark, [1999, 2000]), path)
    sinks.write_year_files(wide(spark, [2000], 50.0), path)
    assert sorted(f for f in os.listdir(path) if not f.startswith(".")) == ["1999.csv", "2000.csv"]
    with open(f"{path}/1999.csv") as file:
        assert file.read() == "Month,v. one,two\nJan,2.0,0.0\nFeb,3.0,-1.0\nDec,13.0,\n"
    with open(f"{path}/2000.csv") as file:
        assert file.readline() == "Month,v. one,two\n" and file.readline().startswith("Jan,51.0")


def test_year_files_of_nothing(spark, tmp_path):
    sinks.write_year_files(wide(spark, [1999]).where("year = 0"), str(tmp_path / "out"))
    assert [f for f in os.listdir(tmp_path / "out") if f.endswith(".csv")] == []


def test_summary_is_one_sorted_file(spark, tmp_path):
    path = str(tmp_path / "s")
    yearly = op.yearly_stats(wide(spark, [2001, 1999, 2000]), naming="suffix")
    for _ in range(2):
        sinks.write_summary(yearly, path)
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(parts) == 1
    with open(f"{path}/{parts[0]}") as file:
        lines = file.read().splitlines()
    assert lines[0] == "Year,v. one_min,v. one_max,v. one_avg,two_min,two_max,two_avg"
    assert [line[:4] for line in lines[1:]] == ["1999", "2000", "2001"]
    back = src.read_summary(spark, path, ["v. one", "two"], "suffix")
    assert back.dtypes[0] == ("Year", "int") and rows(back) == rows(yearly)


def test_series_has_a_folder_per_variable(spark, tmp_path):
    path = str(tmp_path / "series")
    series = op.trend_series(op.yearly_stats(wide(spark, [1999, 2000])), ["v. one", "two"])
    for _ in range(2):
        sinks.write_series(series, path)
    folders = [f for f in os.listdir(path) if f.startswith("variable=")]
    assert sorted(folders) == ["variable=two", "variable=v. one"]
    shape = "year int, stat string, value double, variable string"
    back = spark.read.schema(shape).option("header", True).csv(path)
    assert rows(back.select("variable", "year", "stat", "value")) == rows(series)
