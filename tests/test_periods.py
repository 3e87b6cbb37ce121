"""Periods of names, levels, completeness of files, and numbers from ranges."""

import sys
import datetime as dt
import random

import pytest
from pyspark import cloudpickle

from gridmill.operators import (
    discover_periods,
    discover_variables,
    dropped_by_position,
    file_facts,
    find_periods,
    missing_steps,
    number_by_range,
    strides,
    with_keys,
)
from gridmill.operators import messages as message_operators
from gridmill.operators import periods as module
from gridmill.plans import run
from gridmill.sources import decode_files, describe, materialize, scan_files, split_decoded
from helpers import complete_year, messages

# Workers get what is defined here by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smallest_period(names):
    n = len(names)
    for p in range(1, n // 2 + 1):
        if all(names[i] == names[i + p] for i in range(n - p)):
            return p
    return None


def sequence(spark, files):
    data = [(f, i, n, 2000, None, float(i)) for f, names in files.items() for i, n in enumerate(names)]
    random.Random(1).shuffle(data)
    return messages(spark, data)


def test_periods_against_all_shifts(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 8)
    draw = random.Random(3)
    files = {"aab": list("aab") * 5, "aab cut": list("aab") * 4 + ["a"], "one": ["a"], "same": ["a"] * 9,
             "twice": list("abab"), "once": list("abc"), "gap": list("abc") * 4 + list("ab") + list("abc") * 4,
             "late": list("aab") * 6 + ["x"], "none": list("abcdefgh"), "null": ["a", None] * 6}
    for i in range(150):
        base = [draw.choice("ab") for _ in range(draw.randrange(1, 9))]
        names = (base * 12)[: draw.randrange(1, 60)]
        if draw.random() < 0.3:
            names[draw.randrange(len(names))] = "c"
        files[f"f{i}"] = names
    got = {r["file"]: r["stride"] for r in find_periods(sequence(spark, files)).collect()}
    want = {f: smallest_period(names) for f, names in files.items()}
    assert got == {f: p for f, p in want.items() if p is not None}
    assert sum(p is None for p in want.values()) > 10


def test_names_that_return_in_a_step(spark):
    files = {"x": list("ttuvv") * 30, "y": list("abc") * 4 + list("ab") + list("abc") * 4}
    df = sequence(spark, files)
    got = sorted((r["file"], r["var_ix"], r["name"], r["stride"]) for r in discover_periods(df).collect())
    assert got == [
        *[("x", i, n, 5) for i, n in enumerate(["t", "t #2", "u", "v", "v #2"])],
        # A message is missing, so there is no period: up to the first repeat.
        *[("y", i, n, 3) for i, n in enumerate("abc")],
    ]
    assert {r["stride"] for r in strides(discover_variables(df)).where("file = 'x'").collect()} == {1}


def test_two_levels_in_whole_jobs(spark, tmp_path):
    """The level is a field of the description, or not told at all."""
    source = tmp_path / "in"
    source.mkdir()
    for told in (True, False):
        lines, day = [], dt.date(2001, 1, 1)
        for d in range(365):
            for name, level, value in (("t", 500, 1.0), ("t", 850, 2.0), ("u", 500, 4.0)):
                time = day + dt.timedelta(days=d)
                field = f"level {level}" if told else "surface"
                lines.append(f"{len(lines)}:{name}:{field}:from {time:%Y%m%d}0000|{value + d}\n")
        (source / f"{told}.txt").write_text("".join(lines))

    def decoder(content):
        for line in bytes(content).decode().splitlines():
            description, value = line.split("|")
            yield description, [float(value)]

    def january(outcome):
        return {r["name"]: r["value"] for r in outcome.monthly.where("month = 1").collect()}

    def job(name, **settings):
        outcome = run(spark, str(source), str(tmp_path / f"out{len(list(tmp_path.iterdir()))}"), decoder, glob=name, **settings)
        return january(outcome)

    levels = {"t level 500": 16.0, "t level 850": 17.0, "u level 500": 19.0}
    assert job("True.txt", keys=[3]) == levels
    assert job("True.txt", keys=[3], mode="position") == levels
    assert job("False.txt", mode="position", discovery="period") == {"t": 16.0, "t #2": 17.0, "u": 19.0}
    # Without either all levels are one variable, by time and by position.
    assert job("False.txt") == {"t": 16.5, "u": 19.0}
    assert set(job("False.txt", mode="position")) == {"t"}


def test_keys_of_short_descriptions(spark):
    df = spark.createDataFrame([("1:t:l 1:from 200001010000",), ("1:t",), ("x",), (None,)], "description string")
    named = with_keys(describe(df), [3, 9])
    assert [r["name"] for r in named.collect()] == ["t l 1", "t", None, None]


def steps(file, hours, per_step=2, skip=()):
    start = dt.datetime(2000, 1, 1)
    out = []
    for hour in hours:
        for k in range(per_step + (1 if hour in skip else 0)):
            out.append((file, len(out), f"v{k}", 2000, start + dt.timedelta(hours=hour), 1.0))
    return out


def test_missing_steps(spark):
    hours = [h for h in range(0, 240, 6) if h not in (30, 36, 42, 120)]
    data = steps("gaps", hours) + steps("whole", range(0, 240, 6)) + steps("single", [5]) + steps("odd", range(48), skip=(7, 9))
    data += [("whole", 999, "x", 2000, None, 1.0)]
    got = {tuple(r) for r in missing_steps(messages(spark, data)).collect()}
    start = dt.datetime(2000, 1, 1)

    def at(hour):
        return start + dt.timedelta(hours=hour)

    assert got == {
        ("gaps", "missing steps", at(30), at(42), 3), ("gaps", "missing steps", at(120), at(120), 1),
        ("odd", "uneven steps", at(7), at(9), 2),
    }
    finer = missing_steps(messages(spark, steps("a", [0, 6, 12])), 3 * 3600).collect()
    assert {(r["begins"], r["number"]) for r in finer} == {(at(3), 1), (at(9), 1)}
    assert missing_steps(messages(spark, [])).collect() == []


def test_what_position_drops(spark):
    whole = complete_year(1999, ["a"], 2)
    tail = [("tail.grib", *r[1:]) for r in complete_year(1999, ["a", "b"], 2)]
    tail += [("tail.grib", len(tail) + i, "a", 1999, None, 1.0) for i in range(5)]
    short = [("short.grib", i, "a", 1999, None, 1.0) for i in range(100)]
    got = {tuple(r) for r in dropped_by_position(file_facts(messages(spark, whole + tail + short))).collect()}
    assert got == {
        ("tail.grib", "after the last day", None, None, 5),
        ("short.grib", "fewer messages than days", None, None, 100),
    }


def test_run_writes_incomplete_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [f"{i}:a:x:from {dt.date(2001, 1, 1) + dt.timedelta(days=d):%Y%m%d}0000|1\n" for i, d in enumerate(
        [*range(100), *range(103, 365), 364, 364, 364, 364])]
    (source / "a.txt").write_text("".join(lines))

    def decoder(content):
        for line in bytes(content).decode().splitlines():
            yield line.split("|")[0], [1.0]

    outcome = run(spark, str(source), str(tmp_path / "out"), decoder, glob="*.txt", mode="position", check_steps=True)
    stored = spark.read.json(str(tmp_path / "out" / "incomplete_files"))
    assert {(r["problem"], r["number"]) for r in stored.collect()} == {
        ("after the last day", 1), ("missing steps", 3), ("uneven steps", 1)
    }
    assert outcome.incomplete.count() == 3


def lines_by_range(path, start, end):
    with open(path, "rb") as lines:
        if start:
            lines.seek(start - 1)
            lines.readline()
        while (offset := lines.tell()) < end and (line := lines.readline()):
            yield offset, line.decode().split("|")[0], [float(line.split(b"|")[1])]


@pytest.mark.parametrize("small", [True, False])
def test_numbers_from_ranges(spark, tmp_path, monkeypatch, small):
    for name, count in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 40)):
        (tmp_path / name).write_text("".join(f"{i}:v{i % 3}:x:from 20000101000{i % 10}|{i}\n" for i in range(count)))
    files = scan_files(spark, str(tmp_path), "*.txt")
    decoded = decode_files(files, lines_by_range, "range", range_bytes=700)
    good, bad = split_decoded(decoded, files, "range")
    assert bad.count() == 0
    if not small:
        monkeypatch.setattr(message_operators, "SMALL_RANGES", 1)
    numbered = number_by_range(good)
    got = numbered.select("msg_no", "grid_mean", "offset").collect()
    assert len(got) == 3041 and all(r["msg_no"] == r["grid_mean"] for r in got)
    if small:
        # Messages stay where they are.
        plan = number_by_range(materialize(good))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan

