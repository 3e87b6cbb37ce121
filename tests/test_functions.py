import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridmill import functions as fn


def one(spark, column, schema, value):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "name", "year", "time"),
    [
        ("1:2 metre temperature:K:fcst time 0:from 194101010600", "2 metre temperature", 1941,
         dt.datetime(1941, 1, 1, 6)),
        ("a:b:200002292330", "b", 2000, dt.datetime(2000, 2, 29, 23, 30)),
        ("a:b:from 199902291200", "b", 1999, None),
        ("a:b:unknown stamp!", "b", None, None),
        ("no separator", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_description_fields(spark, text, name, year, time):
    d = F.col("d")
    df = spark.createDataFrame([(text,)], "d string")
    row = df.select(fn.variable_name(d), fn.stamp_year(d), fn.valid_time(d)).first()
    assert tuple(row) == (name, year, time)


def test_valid_time_ignores_session_zone(spark):
    """An hour that the session's zone skips in spring is kept as it stands."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Warsaw")
    try:
        got = one(spark, fn.valid_time(F.col("d")), "d string", "a:b:202303260230")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == dt.datetime(2023, 3, 26, 2, 30)


@pytest.mark.parametrize(("year", "days", "february"), [
    (1900, 366, 29), (1995, 365, 28), (1996, 366, 29), (2000, 366, 29), (2100, 366, 29),
])
def test_every_fourth_year_is_leap(spark, year, days, february):
    df = spark.createDataFrame([(year, 2)], "y int, m int")
    row = df.select(fn.days_per_year(F.col("y")), fn.days_in_month(F.col("y"), F.col("m"))).first()
    assert tuple(row) == (days, february)


def test_months_of_days_cover_the_year(spark):
    for year in (1900, 2001):
        days = spark.range(366 if year == 1900 else 365).select(
            F.lit(year).alias("y"), F.col("id").alias("d")
        )
        got = days.groupBy(fn.month_of_day(F.col("y"), F.col("d")).alias("m")).agg(
            F.count("*").alias("n"),
            F.min("d").alias("first"),
            F.min(fn.days_before_month_of_day(F.col("y"), F.col("d"))).alias("low"),
            F.max(fn.days_before_month_of_day(F.col("y"), F.col("d"))).alias("high"),
        ).orderBy("m").collect()
        lengths = [31, 29 if year == 1900 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        assert [r.n for r in got] == lengths
        assert all(r.first == r.low == r.high for r in got)


def test_month_labels_and_numbers(spark):
    df = spark.range(0, 14).select(F.col("id").cast("int").alias("m"))
    labelled = df.select("m", fn.month_label(F.col("m")).alias("label"))
    got = labelled.select("m", "label", fn.month_number(F.col("label")).alias("n")).collect()
    for row in got:
        if 1 <= row.m <= 12:
            assert row.label == dt.date(2001, row.m, 1).strftime("%b") and row.n == row.m
        else:
            assert row.label is None and row.n is None
    assert one(spark, fn.month_number(F.col("l")), "l string", "Foo") is None


@pytest.mark.parametrize(("path", "year"), [
    ("file:/data/1941.csv", 1941), ("hdfs://host:9000/x/2022.backup.csv", 2022), ("1999", 1999),
    ("/a/+1999.csv", 1999), ("/a/-5.csv", -5), ("/a/summary_data.csv", None), ("/a/1999a.csv", None),
    ("/1999/notes.csv", None), ("/a/99999999999.csv", None), (".csv", None), (None, None),
])
def test_year_from_file_name(spark, path, year):
    assert one(spark, fn.year_from_file_name(F.col("p")), "p string", path) == year


NAN = float("nan")


@pytest.mark.parametrize(("values", "mean"), [
    ([1.0, 2.0, 6.0], 3.0), ([1.0, None, 3.0], 2.0), ([1.0, NAN, 3.0], 2.0), ([NAN, None, 5.0], 5.0),
    ([NAN], None), ([None], None), ([], None), (None, None), ([math.inf, 1.0], math.inf),
])
def test_grid_mean(spark, values, mean):
    for element in ("double", "float"):
        assert one(spark, fn.grid_mean(F.col("v")), f"v array<{element}>", values) == mean


def test_grid_mean_of_opposite_infinities_is_nan(spark):
    got = one(spark, fn.grid_mean(F.col("v")), "v array<double>", [math.inf, -math.inf])
    assert math.isnan(got)


def test_nan_policy_is_checked(spark):
    with pytest.raises(ValueError, match="nan_policy"):
        fn.apply_nan_policy(F.col("v"), "drop")


def test_names_with_dots_blanks_and_backticks(spark):
    name = "odd. `name` here"
    df = spark.createDataFrame([(1.0,)], [name])
    assert df.select(fn.named(name)).first()[0] == 1.0
