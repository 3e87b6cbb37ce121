"""Sums and means whose bits do not depend on how the rows lie."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridmill.functions import exact_sums, mean_of, merge_sums, places, sum_of


def bits(value):
    return None if value is None else struct.pack(">d", value)


def values(seed, n=2000):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        scale = draw.choice([1, 1, 1e-3, 1e15, 1e-15, 1e200, 1e-200])
        out.append(draw.uniform(-1, 1) * scale)
    return out + [0.0, -0.0, 5e-324, -1e308, 1e308, 2.0**-928, 2.0**40, -(2.0**40), 1 / 3]


def table(spark, data):
    return spark.createDataFrame([("k", v) for v in data], "key string, value double")


def test_places_lose_nothing(spark):
    data = [v for v in values(1) if v == 0 or abs(v) > 1e-270]
    got = table(spark, data).select("value", places(F.col("value")).alias("p")).collect()
    for r in got:
        assert sum(Fraction(p["digits"]) * Fraction(2) ** (32 * p["place"]) for p in r["p"]) == Fraction(r["value"])
        assert all(abs(p["digits"]) < 1 << 34 for p in r["p"])


def test_same_bits_for_any_partitions(spark):
    data = values(2)
    seen = set()
    for partitions in (1, 7, 200):
        random.Random(partitions).shuffle(data)
        states = exact_sums(table(spark, data).repartition(partitions), ["key"], "value")
        row = states.select(sum_of(F.col("sums")).alias("s"), mean_of(F.col("count"), F.col("sums")).alias("m")).first()
        seen.add((bits(row["s"]), bits(row["m"])))
    assert len(seen) == 1
    got = struct.unpack(">d", seen.pop()[0])[0]
    assert math.isclose(got, math.fsum(data), rel_tol=4e-16)


def test_cancelling_values(spark):
    data = [1e300, 1.0, -1e300, 2.0**53, 1.0, -(2.0**53)] * 50
    states = exact_sums(table(spark, data).repartition(9), ["key"], "value")
    assert states.select(sum_of(F.col("sums"))).first()[0] == 100.0


def test_states_merge(spark):
    data = values(3)
    whole = exact_sums(table(spark, data), ["key"], "value")
    parts = exact_sums(table(spark, data[:700]), ["key"], "value").unionByName(
        exact_sums(table(spark, data[700:]), ["key"], "value")
    )

    def result(df):
        return [(r[0], bits(r[1])) for r in df.select("count", sum_of(F.col("sums"))).collect()]

    assert result(merge_sums(parts, ["key"])) == result(whole)


@pytest.mark.parametrize("data, want", [
    ([1.0, float("nan")], "nan"), ([1.0, float("inf")], "inf"), ([float("inf"), float("-inf")], "nan"),
    ([None, None], None), ([None, 4.0, 2.0], 3.0), ([float("-inf")], "-inf"), ([0.0], 0.0),
])
def test_odd_values(spark, data, want):
    states = exact_sums(table(spark, data), ["key"], "value")
    got = states.select(mean_of(F.col("count"), F.col("sums"))).first()[0]
    assert str(got) == str(want)


def test_strange_key_names(spark):
    df = table(spark, [1.5]).withColumnRenamed("key", "a.b c")
    assert exact_sums(df, ["a.b c"], "value").columns == ["a.b c", "count", "sums"]
    assert exact_sums(df.where("false"), ["a.b c"], "value").collect() == []
