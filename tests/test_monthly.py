import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridmill import operators as op
from helpers import complete_year, messages, rows

LONG = "year int, month int, name string, value double"


def long_table(spark, data):
    return spark.createDataFrame(data, LONG)


def test_messages_weigh_the_same_and_order_does_not_matter(spark):
    data = complete_year(2000, ["a", "b"], 2)
    first = op.monthly_mean(op.assign_time(messages(spark, data)))
    again = op.monthly_mean(op.assign_time(messages(spark, data[::-1], 3)))
    assert rows(first) == rows(again)
    january = [m[5] for m in data if m[2] == "a" and m[4].month == 1]
    got = first.where("month = 1 and name = 'a'").first()
    assert got.value == pytest.approx(sum(january) / len(january))


def test_monthly_mean_wide_of_a_table(spark):
    data = [(dt.datetime(2000, 1, 1), 1.0, 5.0), (dt.datetime(2000, 1, 31), 3.0, None),
            (dt.datetime(2000, 2, 1), 9.0, 2.0)]
    table = spark.createDataFrame(data, "t timestamp_ntz, `a.b` double, c double")
    got = op.monthly_mean_wide(table, "t", ["a.b", "c"])
    assert got.columns == ["year", "month", "a.b", "c"]
    assert rows(got) == [(2000, 1, 2.0, 5.0), (2000, 2, 9.0, 2.0)]


def test_monthly_wide_keeps_the_given_order_and_odd_names(spark):
    names = ["z. last", "a first", "absent"]
    data = [(2000, 1, "z. last", 1.0), (2000, 1, "a first", 2.0), (2000, 2, "a first", 3.0),
            (2000, 2, "other", 4.0)]
    wide = op.monthly_wide(long_table(spark, data), names)
    assert wide.columns == ["year", "month", *names]
    assert rows(wide) == [(2000, 1, 1.0, 2.0, None), (2000, 2, None, 3.0, None)]


def test_pivot_and_unpivot_are_inverse(spark):
    data = [(y, m, n, float(y * m)) for y in (1, 2) for m in (1, 2, 3) for n in "ab"]
    wide = op.monthly_wide(long_table(spark, data), ["a", "b"])
    back = wide.unpivot(["year", "month"], ["a", "b"], "name", "value")
    assert rows(back) == rows(long_table(spark, data))


def test_monthly_table_shows_labels(spark):
    wide = op.monthly_wide(long_table(spark, [(2000, 12, "a", 1.0)]), ["a"])
    table = op.monthly_table(wide)
    assert table.columns == ["year", "Month", "a"] and rows(table) == [(2000, "Dec", 1.0)]


def test_dense_months_for_given_names(spark):
    data = [(2000, 1, "a", 1.0), (2000, 3, "a", None), (2001, 5, "b", 2.0)]
    dense = op.dense_months(long_table(spark, data), ["a", "b", "c"])
    got = {(r.year, r.month, r.name): r.value for r in dense.collect()}
    assert len(got) == dense.count() == 2 * 12 * 3
    assert {k: v for k, v in got.items() if v is not None} == {
        (2000, 1, "a"): 1.0, (2001, 5, "b"): 2.0
    }
    assert "CartesianProduct" not in dense._jdf.queryExecution().executedPlan().toString()


def test_dense_months_for_names_present_with_nan(spark):
    data = [(2000, 1, "a", 1.0), (2000, 3, "a", None), (2001, 5, "b", 2.0)]
    dense = op.dense_months(long_table(spark, data), empty=math.nan)
    got = {(r.year, r.month, r.name): r.value for r in dense.collect()}
    assert {k[::2] for k in got} == {(2000, "a"), (2001, "b")} and len(got) == 24
    # A month that is there without a value stays null; a month that is not there turns NaN.
    assert got[2000, 3, "a"] is None and math.isnan(got[2000, 2, "a"])


def test_dense_months_of_given_years(spark):
    years = spark.createDataFrame([(2000,), (2001,)], "year int")
    dense = op.dense_months(long_table(spark, [(2000, 1, "a", 1.0)]), ["a"], years=years)
    assert [r.value for r in dense.where("year = 2001").collect()] == [None] * 12
    assert dense.count() == 24


def test_keep_last_per_year(spark):
    data = [(2000, "a.grib", 1), (2000, "b.grib", 2), (2000, "b.grib", 3), (2001, "a.grib", 4)]
    table = spark.createDataFrame(data, "year int, file string, v int")
    assert rows(op.keep_last_per_year(table)) == [
        (2000, "b.grib", 2), (2000, "b.grib", 3), (2001, "a.grib", 4)
    ]
    facts = table.groupBy("file", "year").agg(F.count("*").alias("num"))
    assert rows(op.keep_last_files(facts)) == [(2000, "b.grib", 2), (2001, "a.grib", 1)]


def test_first_file_schema(spark):
    """Every year is cut to the variables of the first file, in its order."""
    data = [("1999.grib", i, n, 1999, dt.datetime(1999, 1, 1), float(i)) for i, n in enumerate("ba")]
    data += [("2000.grib", i, n, 2000, dt.datetime(2000, 1, 1), float(i)) for i, n in enumerate("acb")]
    table = messages(spark, data)
    names = op.first_file_names(op.discover_variables(table))
    assert rows(names) == [(0, "b"), (1, "a")]
    monthly = op.monthly_mean(op.assign_time(table))
    got = op.first_file_schema(monthly, names).select("year", "var_ix", "name", "value")
    assert rows(got) == [(1999, 0, "b", 0.0), (1999, 1, "a", 1.0), (2000, 0, "b", 2.0), (2000, 1, "a", 0.0)]
