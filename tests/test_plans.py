import math
import os
import subprocess
import sys

import pytest

from gridmill import run, sinks, summarize_folder
from gridmill import operators as op
from gridmill.plans import first_file_variables, monthly_from_messages
from helpers import complete_year, means, messages, position_means, rows

NAMES = ["t 2m", "u.wind", "rain"]


def decoder():
    def decode(content):
        for line in bytes(content).decode().splitlines():
            yield line.split("|")[0], [float(x) for x in line.split("|")[1].split(",")]

    return decode


def write_file(path, data):
    with open(path, "w") as file:
        for _, msg_no, name, _, time, value in data:
            file.write(f"{msg_no}:{name}:from {time:%Y%m%d%H%M}|{value - 1},{value + 1}\n")


@pytest.fixture
def folder(tmp_path):
    """Two years, a bad file, and an older file of 2000 that the later name replaces."""
    source = tmp_path / "in"
    source.mkdir()
    years = {}
    for year in (1999, 2000):
        years[year] = complete_year(year, NAMES, 2)
        write_file(source / f"{year}b.grib", years[year])
    write_file(source / "2000a.grib", complete_year(2000, NAMES, 1, lambda i: 1e6))
    (source / "bad.grib").write_text("0:t 2m:from 199901010000|1,2\nno numbers\n")
    return str(source), str(tmp_path / "out"), [m for data in years.values() for m in data]


def shown(target):
    """What a job leaves besides its scratch."""
    return sorted(name for name in os.listdir(target) if not name.startswith("_"))


def expected_monthly(data):
    return means(((m[3], m[4].month, m[2]), m[5]) for m in data)


@pytest.mark.parametrize("mode", ["time", "position"])
@pytest.mark.parametrize("variables", [None, NAMES])
def test_run(spark, folder, mode, variables):
    source, target, data = folder
    outcome = run(spark, source, target, decoder(), variables=variables, mode=mode, same_year="last")
    assert outcome.variables == NAMES and outcome.lacking == ()
    spans = spark.read.option("header", True).csv(f"{target}/series_span").collect()
    assert {(r.variable, r.first_year, r.last_year) for r in spans} == {(n, "1999", "2000") for n in NAMES}
    assert [r.file.rsplit("/", 1)[-1] for r in outcome.bad_files.collect()] == ["bad.grib"]

    monthly = expected_monthly(data)
    got = {(r.year, r.month, r.name): r.value for r in outcome.monthly.collect()}
    assert got.keys() == monthly.keys()
    assert all(got[k] == pytest.approx(monthly[k]) for k in monthly)

    series = {(r.variable, r.year, r.stat): r.value for r in outcome.series.collect()}
    assert len(series) == 3 * 2 * 3
    for name in NAMES:
        months = [monthly[2000, m, name] for m in range(1, 13)]
        assert series[name, 2000, "min"] == pytest.approx(min(months))
        assert series[name, 2000, "max"] == pytest.approx(max(months))
        assert series[name, 2000, "avg"] == pytest.approx(sum(months) / 12)
    dropped = ["incomplete_files"] if mode == "position" else []
    assert shown(target) == ["bad_files", *dropped, "monthly", "replaced_files", "series", "series_span", "summary"]
    replaced = [(r.file.rsplit("/", 1)[-1], r.year, r.messages) for r in outcome.replaced.collect()]
    assert replaced == [("2000a.grib", 2000, 366 * 3)]
    outcome.release()
    assert os.listdir(target) and not any(n.startswith("_") for n in os.listdir(target))


def range_decoder():
    def decode(path, start, end):
        with open(path, "rb") as lines:
            if start:
                lines.seek(start - 1)
                lines.readline()
            while (offset := lines.tell()) < end and (line := lines.readline().decode()):
                yield offset, line.split("|")[0], [float(x) for x in line.split("|")[1].split(",")]

    return decode


@pytest.mark.parametrize("mode", ["time", "position"])
def test_run_by_ranges(spark, folder, mode):
    """The same results when each file is decoded in pieces."""
    source, target, data = folder
    outcome = run(
        spark, source, target, range_decoder(), mode=mode, decode_by="range", range_bytes=20_000,
        same_year="last",
    )
    monthly = expected_monthly(data)
    got = {(r.year, r.month, r.name): r.value for r in outcome.monthly.collect()}
    assert got == {k: pytest.approx(v) for k, v in monthly.items()}
    assert outcome.bad_files.count() == 1


def test_nothing_chosen_stops_after_the_monthly_tables(spark, folder):
    source, target, _ = folder
    outcome = run(spark, source, target, decoder(), chosen=[])
    assert outcome.yearly is None and outcome.series is None
    assert shown(target) == ["bad_files", "monthly"]


def test_chosen_variables_without_data_are_reported(spark, folder):
    source, target, _ = folder
    outcome = run(spark, source, target, decoder(), chosen=["rain", "snow"], naming="suffix")
    assert outcome.lacking == ("snow",)
    assert {r.variable for r in outcome.series.collect()} == {"rain"}
    assert outcome.yearly.columns[:2] == ["Year", "t 2m_min"]


def parts_of_years(folder):
    """2000 in two files, the second of which begins on New Year's Eve and has a further variable."""
    folder.mkdir()
    old, new = complete_year(1999, ["a"], 1), complete_year(2000, ["a", "late"], 1)
    first = [m for m in new if m[4].month <= 6 and m[2] == "a"]
    second = old[-1:] + [m for m in new if m[4].month > 6]
    write_file(folder / "1999.grib", old[:-1])
    write_file(folder / "2000a.grib", first)
    write_file(folder / "2000b.grib", second)
    return str(folder), old + first + second[1:]


def test_the_default_loses_nothing(spark, tmp_path):
    source, data = parts_of_years(tmp_path / "in")
    outcome = run(spark, source, str(tmp_path / "out"), decoder())
    got = {(r.year, r.month, r.name): r.value for r in outcome.monthly.collect() if r.value is not None}
    assert outcome.variables == ["a", "late"]
    assert got == {k: pytest.approx(v) for k, v in expected_monthly(data).items()}
    assert outcome.replaced is None and outcome.left_out is None


def test_explicit_choices_say_what_they_leave_out(spark, tmp_path):
    source, _ = parts_of_years(tmp_path / "in")
    target = str(tmp_path / "out")
    outcome = run(spark, source, target, decoder(), same_year="last", columns="first_file")
    assert outcome.variables == ["a"]
    assert [r.name for r in outcome.left_out.collect()] == ["late"]
    # The file that begins on New Year's Eve counts as one of 1999.
    assert [r.file.rsplit("/", 1)[-1] for r in outcome.replaced.collect()] == ["1999.grib"]
    assert shown(target) == ["bad_files", "left_out", "monthly", "replaced_files", "series", "series_span", "summary"]


def test_long_layout_with_many_variables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "1.grib", "w") as file:
        for i in range(6000):
            file.write(f"{i}:v{i}:from 200003010000|{i},{i}\n")
    target = str(tmp_path / "out")
    outcome = run(spark, str(tmp_path / "in"), target, decoder(), layout="long", years=[2000, 2001])
    assert outcome.variables == [] and outcome.yearly.count() == 12_000
    assert outcome.series.where("year = 2000 and value is not null").count() == 18_000
    written = spark.read.option("header", True).csv(f"{target}/monthly")
    assert written.count() == 72_000 and written.where("value is not null").count() == 6000
    with pytest.raises(ValueError, match="long"):
        run(spark, str(tmp_path / "in"), target, decoder(), layout="long", columns="first_file")


@pytest.mark.parametrize("files", ["folders", "year_files"])
def test_two_steps(spark, tmp_path, files):
    source, _ = parts_of_years(tmp_path / "in")
    target = str(tmp_path / "out")
    whole = run(spark, source, target, decoder(), monthly_files=files)
    again = summarize_folder(spark, f"{target}/monthly", str(tmp_path / "again"))
    assert again.variables == whole.variables
    assert rows(again.series) == rows(whole.series) and again.series.count() == 2 * 2 * 3
    assert again.bad_files.count() == 0


def test_a_folder_without_years_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notes.csv").write_text("Month,a\nJan,1\n")
    with pytest.raises(ValueError, match="year"):
        summarize_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_values_at_an_hour(spark, tmp_path):
    source, data = parts_of_years(tmp_path / "in")
    at = next(m[4] for m in data if m[4].month == 8)
    target = str(tmp_path / "out")
    run(spark, source, target, decoder(), at=at)
    values = spark.read.option("header", True).csv(f"{target}/values")
    assert values.count() == sum(m[4].date() == at.date() and m[4].hour == at.hour for m in data) > 0


def test_runs_release_their_own_scratch(spark, tmp_path):
    source, _ = parts_of_years(tmp_path / "in")
    first = run(spark, source, str(tmp_path / "out1"), decoder())
    second = run(spark, source, str(tmp_path / "out2"), decoder())
    first.release()
    assert second.monthly.count() > 0 and not os.path.exists(first.scratch)


def test_position_mode_scans_the_messages_seldom(spark, tmp_path, monkeypatch):
    """Facts, discovered variables (first uses and repeats) and positions, whatever is derived."""
    from gridmill.plans import climate

    source, _ = parts_of_years(tmp_path / "in")
    plans = []

    def stored(df, label="table"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return climate_materialize(df, label)

    climate_materialize = climate.materialize
    monkeypatch.setattr(climate, "materialize", stored)
    run(spark, source, str(tmp_path / "out"), decoder(), mode="position")
    scans = sum(p.count("msg_no") > 0 and "grid_mean" in p for p in plans)
    assert scans <= 3


def test_no_file_decodes(spark, tmp_path):
    (tmp_path / "x.grib").write_text("junk")
    target = str(tmp_path / "out")
    outcome = run(spark, str(tmp_path), target, decoder(), variables=["a"])
    assert outcome.monthly.count() == outcome.yearly.count() == 0 and outcome.bad_files.count() == 1


@pytest.mark.parametrize("mode", ["time", "position"])
def test_no_file_decodes_and_no_variable_is_known(spark, tmp_path, mode):
    (tmp_path / "x.grib").write_text("junk")
    target = str(tmp_path / "out")
    outcome = run(spark, str(tmp_path), target, decoder(), mode=mode)
    assert outcome.variables == [] and outcome.series.count() == outcome.monthly.count() == 0


@pytest.mark.parametrize("mode", ["time", "position"])
@pytest.mark.parametrize("policy", ["skip", "propagate"])
def test_months_and_years_without_data(spark, tmp_path, mode, policy):
    """1999 ends in April; by position that is less than a message a day, so no month has data."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write_file(source / "1999.grib", complete_year(1999, ["a"], 1, float)[:100])
    outcome = run(spark, str(source), target, decoder(), mode=mode, nan_policy=policy)
    months = {r.month: r.value for r in outcome.monthly.collect()}
    assert len(months) == 12
    blank = math.nan if policy == "propagate" else None
    full = {1: 15.0, 2: 44.5, 3: 74.0, 4: 94.5} if mode == "time" else {}
    assert {m: str(v) for m, v in months.items()} == {
        m: str(full.get(m, blank)) for m in range(1, 13)
    }
    yearly = outcome.yearly.first()
    if mode == "time":
        expected = (1999, 15.0, 94.5, 57.0) if policy == "skip" else (1999, 15.0, blank, blank)
    else:
        expected = (1999, blank, blank, blank)
    assert str(tuple(yearly)) == str(expected)


def test_legacy_first_step_changes_january_only(spark):
    data = complete_year(1999, ["a", "b"], 1, value=lambda i: 1000.0 if i == 0 else float(i % 7))
    table = messages(spark, data)
    plain = {tuple(r)[:3]: r.value for r in monthly_from_messages(table, "position").collect()}
    legacy = monthly_from_messages(table, "position", legacy_first_step=True)
    old = {tuple(r)[:3]: r.value for r in legacy.collect()}
    changed = {k for k in plain if plain[k] != old[k]}
    assert changed == {(1999, 1, "a"), (1999, 1, "b")}
    replaced = [(*m[:5], 1000.0) if m[1] <= 2 else m for m in data]
    walk = position_means(replaced, 2)
    assert old[1999, 1, "b"] == pytest.approx(walk[1999, 1, 1])


def test_stride_override_for_variables_on_two_levels(spark):
    """One name twice in a step ends discovery early; a given list and stride mend it."""
    data = complete_year(1999, ["a", "a", "b"], 1)
    got = monthly_from_messages(messages(spark, data), "position", ["low", "high", "b"])
    walk = position_means(data, 3)
    assert {tuple(r)[:3]: pytest.approx(r.value) for r in got.collect()} == {
        (y, m, ["low", "high", "b"][v]): value for (y, m, v), value in walk.items()
    }


def test_each_file_is_read_with_its_own_variables(spark):
    data = complete_year(1999, ["a", "b"], 1) + complete_year(2000, ["c", "a", "d"], 1)
    got = {tuple(r)[:3]: r.value for r in monthly_from_messages(messages(spark, data), "position").collect()}
    assert got.keys() == expected_monthly(data).keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected_monthly(data).items())
    assert first_file_variables(messages(spark, data)) == ["a", "b"]


def test_variables_of_the_first_file(spark):
    """Time mode takes all names; position mode stops at the first repeat."""
    data = complete_year(2000, ["z"], 1) + complete_year(1999, ["c", "a", "a", "b"], 1)
    assert first_file_variables(messages(spark, data)) == ["c", "a", "b"]
    assert first_file_variables(messages(spark, data), "position") == ["c", "a"]


def test_mode_is_checked(spark):
    with pytest.raises(ValueError, match="mode"):
        monthly_from_messages(messages(spark, complete_year(1999, ["a"], 1)), "guess")


def test_summarize_folder(spark, tmp_path):
    data = [(y, m, n, float(y + m)) for y in (1999, 2000) for m in range(1, 13) for n in ("a", "b. c")]
    monthly = spark.createDataFrame(data, "year int, month int, name string, value double")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    sinks.write_year_files(op.monthly_wide(monthly, ["a", "b. c"]), source)
    with open(f"{source}/summary_data.csv", "w") as file:
        file.write("Year,a_min\n1999,1\n")
    with open(f"{source}/notes.csv", "w") as file:
        file.write("Month,a\nJan,77777\n")
    outcome = summarize_folder(spark, source, target, ["a", "b. c", "zz"], chosen=["a"])
    assert rows(outcome.series) == sorted(
        ("a", y, s, float(y) + v) for y in (1999, 2000) for s, v in (("min", 1), ("max", 12), ("avg", 6.5))
    )
    assert outcome.yearly.where("min_zz is not null").count() == 0


@pytest.mark.parametrize("naming", ["prefix", "suffix"])
def test_summary_of_given_years(spark, tmp_path, naming):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1999.csv").write_text("Month,a\nJan,1.0\n")
    outcome = summarize_folder(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), ["a"], naming=naming, years=range(1998, 2000)
    )
    assert rows(outcome.yearly) == [(1998, None, None, None), (1999, 1.0, 1.0, 1.0)]


def test_summary_counts_every_line_of_a_year(spark, tmp_path):
    """Labels that are no English month, and two files of one year."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "1999.csv").write_text("Month,a\nsty,1.0\nlut,9.0\n")
    (source / "1999.more.csv").write_text("Month,a\nsty,2.0\n")
    outcome = summarize_folder(spark, str(source), str(tmp_path / "out"), ["a"])
    assert rows(outcome.yearly) == [(1999, 1.0, 9.0, 4.0)]


def test_command_line(tmp_path):
    """The job as its own process, as spark-submit would run it."""
    source = tmp_path / "in"
    source.mkdir()
    write_file(source / "1999.grib", complete_year(1999, ["a"], 1))
    (tmp_path / "toy_decoder.py").write_text(
        "def decode(content):\n"
        "    for line in bytes(content).decode().splitlines():\n"
        "        yield line.split('|')[0], [float(x) for x in line.split('|')[1].split(',')]\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": f"{root}:{tmp_path}",
           "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false "
                                  f"--conf spark.checkpoint.dir={tmp_path}/scratch pyspark-shell"}
    command = [sys.executable, "-m", "gridmill", str(source), str(tmp_path / "out"),
               "--decoder", "toy_decoder:decode", "--mode", "position", "--stride", "1",
               "--years", "1998-1999", "--chosen", "a", "--chosen", "z"]
    done = subprocess.run(command, env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "no data for variable: z" in done.stdout
    assert os.listdir(tmp_path / "scratch") == [] or not any(
        name.startswith("gridmill-") for name in os.listdir(tmp_path / "scratch")
    )
    summary = [f for f in os.listdir(tmp_path / "out" / "summary") if f.endswith(".csv")]
    with open(tmp_path / "out" / "summary" / summary[0]) as file:
        lines = file.read().splitlines()
    assert lines[0] == "year,min_a,max_a,avg_a" and lines[1] == "1998,,,"
    assert lines[2].startswith("1999,")


def test_files_of_one_year_may_be_parts_of_it(spark):
    data = complete_year(1999, ["a", "b"], 2)
    parts = [(f"1999-{m[4].month % 4}.grib", *m[1:]) for m in data]
    merged = monthly_from_messages(messages(spark, parts), same_year="merge")
    got = {tuple(r)[:3]: r.value for r in merged.collect()}
    assert got == {k: pytest.approx(v) for k, v in expected_monthly(data).items()}
    last = monthly_from_messages(messages(spark, parts), same_year="last")
    assert {r.month for r in last.collect()} == {3, 7, 11}
    with pytest.raises(ValueError, match="same_year"):
        monthly_from_messages(messages(spark, parts), "position", same_year="merge")
