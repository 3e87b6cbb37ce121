import pytest

from gridmill import operators as op
from gridmill.functions import stat_columns
from helpers import rows

VARIABLES = ["min_cloud", "wind. 10m", "x"]


def summary(spark, naming):
    columns = stat_columns(VARIABLES, naming)
    shape = ", ".join(["year int" if naming == "prefix" else "Year int"]
                      + [f"`{c}` double" for c in columns])
    data = [(y, *[float(y * 10 + i) for i in range(9)]) for y in (1, 2)]
    return spark.createDataFrame(data, shape)


@pytest.mark.parametrize("naming", ["prefix", "suffix"])
def test_trend_series(spark, naming):
    series = op.trend_series(summary(spark, naming), VARIABLES, naming)
    assert series.columns == ["variable", "year", "stat", "value"]
    got = {(r.variable, r.year, r.stat): r.value for r in series.collect()}
    assert got == {
        (v, y, s): float(y * 10 + 3 * i + j)
        for y in (1, 2)
        for i, v in enumerate(VARIABLES)
        for j, s in enumerate(["min", "max", "avg"])
    }
    assert rows(op.series_span(series)) == sorted((v, 1, 2) for v in VARIABLES)


def test_trend_series_of_nothing(spark):
    series = op.trend_series(summary(spark, "prefix"), [])
    assert series.columns == ["variable", "year", "stat", "value"] and series.count() == 0


def test_trend_series_long_equals_wide(spark):
    long = spark.createDataFrame([(1, "a", 1.0, 3.0, 2.0)], "year int, name string, min double, max double, avg double")
    wide = op.yearly_wide(long, ["a"])
    assert rows(op.trend_series_long(long)) == rows(op.trend_series(wide, ["a"]))


def test_choice_on_long_tables(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    assert rows(op.select_variables(table, ["b", "zz"])) == [("b", 2)]
    assert op.select_variables(table, []).count() == 0
    assert rows(op.missing_variables(spark, ["b", "zz"], table)) == [("zz",)]


def test_choice_on_wide_tables_reports_what_lacks_a_column(spark):
    table = summary(spark, "prefix").drop("max_x")
    picked, lacking = op.select_summary(table, ["x", "wind. 10m", "absent"])
    assert lacking == ["x", "absent"]
    assert picked.columns == ["year", "min_wind. 10m", "max_wind. 10m", "avg_wind. 10m"]
