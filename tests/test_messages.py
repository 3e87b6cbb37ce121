import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridmill import operators as op
from gridmill.operators import numbering
from gridmill.sources import materialize
from helpers import MESSAGES, complete_year, means, messages, position_means, rows


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def close(got, expected):
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, rel=1e-12), key


def position(spark, data, stride=None):
    table = messages(spark, data)
    facts = op.file_facts(table)
    if stride is None:
        facts = facts.join(op.strides(op.discover_variables(table)), "file")
    return op.assign_position(table, materialize(facts), stride)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- numbering ----------------------------------------------------------------------------


@pytest.fixture
def many_slices(spark):
    """Small test data would end up in one slice."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.mark.parametrize("seed", [1, 2])
def test_number_messages_equals_rank(spark, seed, many_slices):
    """One file holds a third of the rows, and one moment a third of that file."""
    rng = random.Random(seed)
    data = []
    for key in range(3000):
        file = "hot" if key % 3 == 0 else f"f{rng.randrange(40)}"
        time = dt.datetime(2000, 1, 1) + dt.timedelta(hours=0 if key % 9 == 0 else rng.randrange(99))
        data.append((file, time, key))
    rng.shuffle(data)
    table = spark.createDataFrame(data, "file string, time timestamp_ntz, key bigint").repartition(13)
    got = {r.key: r.msg_no for r in op.number_messages(table, ["time", "key"]).collect()}
    seen, expected = {}, {}
    for file, _, key in sorted(data):
        expected[key] = seen.setdefault(file, 0)
        seen[file] += 1
    assert got == expected


def test_number_messages_sorts_no_file_in_one_task(spark, many_slices, monkeypatch):
    """The only file is cut into slices of about the same size."""
    written = []
    monkeypatch.setattr(numbering, "materialize", lambda df, _: written.append(materialize(df)) or written[-1])
    data = complete_year(2001, ["a", "b"], 2)
    table = messages(spark, data).drop("msg_no")
    numbered = op.number_messages(table, ["valid_time", "name"])
    plan = executed(numbered)
    assert "Window" not in plan and "SortMergeJoin" not in plan
    sizes = [r["count"] for r in written[0].groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < len(data) / 4


def test_number_messages_empty(spark):
    empty = spark.createDataFrame([], "file string, time timestamp_ntz")
    assert op.number_messages(empty, ["time"]).collect() == []


# --- file facts ---------------------------------------------------------------------------


def test_file_facts(spark):
    data = complete_year(1999, ["a"], 1) + complete_year(2000, ["a", "b"], 1)
    # The year of a file is that of its first message, whatever the others say.
    data.append(("1999.grib", 365, "a", 2000, dt.datetime(2000, 1, 1), 5.0))
    table = messages(spark, data)
    assert rows(op.file_year(table)) == [("1999.grib", 1999), ("2000.grib", 2000)]
    assert rows(op.file_counts(table)) == [("1999.grib", 366), ("2000.grib", 732)]
    facts = op.messages_per_day(op.file_facts(table))
    got = {r.file: (r.num, r.year, r.first_mean, r.days, r.per_day) for r in facts.collect()}
    assert got == {"1999.grib": (366, 1999, 0.0, 365, 1), "2000.grib": (732, 2000, 0.0, 366, 2)}


# --- discovery ----------------------------------------------------------------------------


def discover(spark, names, file="f"):
    time = dt.datetime(2000, 1, 1)
    data = [(file, i, name, 2000, time, 0.0) for i, name in enumerate(names)]
    got = op.discover_variables(messages(spark, data))
    return sorted((r.var_ix, r.name, r.stride) for r in got.collect())


def test_discover_up_to_the_first_repeat(spark):
    assert discover(spark, "abcabc") == [(0, "a", 3), (1, "b", 3), (2, "c", 3)]
    assert discover(spark, "abcbda") == [(0, "a", 3), (1, "b", 3), (2, "c", 3)]


def test_discover_without_a_repeat_takes_all(spark):
    assert discover(spark, "abc") == [(0, "a", 3), (1, "b", 3), (2, "c", 3)]
    assert discover(spark, "a") == [(0, "a", 1)]


def test_discover_ends_early_on_two_levels(spark):
    assert discover(spark, "abbcabbc") == [(0, "a", 2), (1, "b", 2)]
    assert discover(spark, "aabb") == [(0, "a", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_discover_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    data, expected = [], []
    for file in range(12):
        names = [f"n{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))]
        walked = []
        for name in names:
            if name in walked:
                break
            walked.append(name)
        expected += [(f"f{file}", ix, name, len(walked)) for ix, name in enumerate(walked)]
        time = dt.datetime(2000, 1, 1)
        data += [(f"f{file}", i, name, 2000, time, 0.0) for i, name in enumerate(names)]
    got = op.discover_variables(messages(spark, data))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_discover_scans_once(spark):
    """The three uses of the first-use table share one exchange."""
    table = materialize(messages(spark, complete_year(2001, ["a", "b"], 1)))
    plan = executed(op.discover_variables(table)).split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2
    assert "Window" not in plan


# --- position mode ------------------------------------------------------------------------


@pytest.mark.parametrize("year", [1999, 2000])
@pytest.mark.parametrize(("names", "steps"), [("abc", 2), ("a", 1), ("abcde", 4)])
def test_position_mode_equals_time_mode_on_complete_files(spark, year, names, steps):
    data = complete_year(year, list(names), steps)
    placed = op.monthly_mean(position(spark, data), ["year", "month", "var_ix"])
    labelled = op.label_by_position(placed, list(names))
    timed = op.monthly_mean(op.assign_time(messages(spark, data)))
    expected = means(((m[3], m[4].month, m[2]), m[5]) for m in data)
    close(by_key(labelled, "year", "month", "name"), expected)
    close(by_key(timed, "year", "month", "name"), expected)
    assert len(expected) == 12 * len(names)


@pytest.mark.parametrize("seed", range(4))
def test_position_mode_equals_a_walk(spark, seed):
    """Any message count, stride and order of names."""
    rng = random.Random(seed)
    data, expected = [], {}
    stride = rng.randrange(1, 7)
    for year in rng.sample(range(1890, 2105), 3):
        count = rng.randrange(365, 2500)
        part = [
            (f"{year}.grib", i, "x", year, dt.datetime(year, 1, 1), float(rng.randrange(1000)))
            for i in range(count)
        ]
        data += part
        expected |= position_means(part, stride)
    got = op.monthly_mean(position(spark, data, stride), ["year", "month", "var_ix"])
    close(by_key(got, "year", "month", "var_ix"), expected)


def test_tail_after_the_last_day_is_dropped(spark):
    data = complete_year(1999, ["a"], 1)
    extra = [("1999.grib", 365 + i, "a", 1999, dt.datetime(2000, 1, 1), 1e9) for i in range(5)]
    assert position(spark, data + extra).count() == 365


def test_fewer_messages_than_days_give_no_month(spark):
    data = complete_year(1999, ["a"], 1)[:100]
    assert position(spark, data).count() == 0


@pytest.mark.parametrize(("count", "february"), [(366, 29), (365, 0)])
def test_1900_is_leap_in_position_mode(spark, count, february):
    time = dt.datetime(1900, 1, 1)
    data = [("1900.grib", i, "a", 1900, time, 1.0) for i in range(count)]
    got = position(spark, data).where("month = 2").count()
    assert got == february


def test_stride_may_differ_from_the_names(spark):
    """Three names at stride 4: the fourth in turn is not read."""
    data = complete_year(1999, list("abcd"), 1)
    placed = op.monthly_mean(position(spark, data, 4), ["year", "month", "var_ix"])
    got = by_key(op.label_by_position(placed, ["x", "y", "z"]), "year", "month", "name")
    walk = position_means(data, 4)
    close(got, {(y, m, "xyz"[v]): value for (y, m, v), value in walk.items() if v < 3})


def test_legacy_first_step(spark):
    """Messages 0..stride of January take the mean of message 0; the rest stays."""
    data = complete_year(1999, ["a", "b"], 1, value=lambda i: 1000.0 + i if i < 9 else 1.0)
    placed = position(spark, data)
    got = {r.msg_no: r.grid_mean for r in op.legacy_first_step(placed).collect()}
    assert [got[i] for i in range(5)] == [1000.0, 1000.0, 1000.0, 1003.0, 1004.0]
    assert {r.msg_no: r.grid_mean for r in placed.collect()}[1] == 1001.0
    assert got[31 * 2] == 1.0


def test_position_mode_moves_no_message(spark):
    """Facts are small and of known size: the messages meet them without an exchange."""
    table = materialize(messages(spark, complete_year(1999, ["a", "b"], 2)))
    facts = materialize(op.file_facts(table))
    plan = executed(op.assign_position(table, facts, 2))
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "ShuffleQueryStage" not in plan


def test_position_mode_with_large_facts_sorts_and_merges(spark):
    """Beyond the broadcast threshold the same rows come out of a shuffled join."""
    data = complete_year(1999, ["a", "b"], 1) + complete_year(2000, ["a", "b"], 1)
    expected = rows(position(spark, data, 2))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(adaptive, "-1")
    try:
        placed = position(spark, data, 2)
        assert "SortMergeJoin" in executed(placed)
        assert rows(placed) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset(adaptive)


def test_value_at(spark):
    data = complete_year(1999, ["a", "b"], 24)
    table = materialize(spark.createDataFrame(data, MESSAGES))
    got = op.value_at(table, dt.date(1999, 12, 31), 23)
    assert [(r.valid_time, r.name) for r in got.orderBy("name").collect()] == [
        (dt.datetime(1999, 12, 31, 23), "a"), (dt.datetime(1999, 12, 31, 23), "b"),
    ]
    assert "GreaterThanOrEqual(valid_time" in executed(got)
    assert op.value_at(table, dt.date(2000, 1, 1), 0).count() == 0
