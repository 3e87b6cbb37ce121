"""Sums of doubles that do not depend on the order of the rows.

Floating-point addition rounds at every step, so a sum depends on how the rows lie in partitions.
Here each value is split without loss into whole numbers of fixed binary places, which add up
exactly in any order, and the places are put together once at the end. The sum of a group is thus
a short list of whole numbers: two such lists merge by adding, whatever rows they come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.quoting import named

#: Bits of a place. A place holds 2**30 values and more before a bigint is full.
PLACE_BITS = 32
#: Places between which a double of at least 2**-928 lies; digits below 2**-992 are left out.
_LOWEST, _HIGHEST = -29, 31
#: A finite value has three places at most: 53 bits from anywhere in the first.
_PARTS = 3
#: The places of what is no finite number.
_NAN, _PLUS, _MINUS = 1000, 1001, 1002

SUMS = "array<struct<place:int,digits:bigint>>"


def _power(place: Column) -> Column:
    return F.pow(F.lit(2.0), place * PLACE_BITS)


def places(value: Column) -> Column:
    """The value (not null) as ``array<struct<place, digits>>``: the sum of digits * 2**(32 * place)."""
    infinite = F.lit(float("inf"))
    first = F.floor(F.log2(F.abs(value)) / PLACE_BITS).cast("int")
    first = F.greatest(F.least(first, F.lit(_HIGHEST)), F.lit(_LOWEST))
    parts, rest = [], value
    for i in range(_PARTS):
        place = first - i
        # Multiplying by powers of two and taking whole parts off loses nothing.
        digits = F.when(rest < 0, F.ceil(rest / _power(place))).otherwise(F.floor(rest / _power(place)))
        parts.append(F.struct(place.alias("place"), digits.cast("bigint").alias("digits")))
        rest = rest - digits.cast("double") * _power(place)

    def special(place: int) -> Column:
        return F.array(F.struct(F.lit(place).alias("place"), F.lit(1).cast("bigint").alias("digits")))

    return (
        F.when(F.isnan(value), special(_NAN))
        .when(value == infinite, special(_PLUS))
        .when(value == -infinite, special(_MINUS))
        .when(value == 0, F.array().cast(SUMS))
        .otherwise(F.array(*parts))
    )


def exact_sums(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``<keys>, count, sums`` of the values that are not null: partial states, which
    ``merge_sums`` adds up."""
    own = [named(key) for key in keys]
    held = table.select(
        *own, F.when(named(value).isNull(), F.array().cast(SUMS)).otherwise(places(named(value))).alias("sums"),
        named(value).isNotNull().cast("bigint").alias("count"),
    )
    return _added(held, keys)


def merge_sums(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of the same keys as one."""
    return _added(states.select(*[named(key) for key in keys], "sums", "count"), keys)


def _added(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = [named(key) for key in keys]
    # The count rides along as a place of its own, so that one aggregation adds all.
    counted = F.concat("sums", F.array(F.struct(F.lit(None).cast("int").alias("place"), F.col("count").alias("digits"))))
    added = (
        states.select(*own, F.explode(counted).alias("_part"))
        .groupBy(*own, F.col("_part.place").alias("_place"))
        .agg(F.sum("_part.digits").alias("_digits"))
    )
    entry = F.struct(F.col("_place").alias("place"), F.col("_digits").alias("digits"))
    sums = F.collect_list(F.when(F.col("_place").isNotNull(), entry))
    return added.groupBy(*own).agg(
        F.max(F.when(F.col("_place").isNull(), F.col("_digits"))).alias("count"),
        F.sort_array(sums, asc=False).cast(SUMS).alias("sums"),
    )


def sum_of(sums: Column) -> Column:
    """The sum as a double: from the highest place down, always in this order."""

    def has(place: int) -> Column:
        return F.exists(sums, lambda s: (s["place"] == place) & (s["digits"] != 0))

    finite = F.filter(sums, lambda s: s["place"] < _NAN)
    total = F.aggregate(
        finite, F.lit(0.0), lambda t, s: t + s["digits"].cast("double") * _power(s["place"])
    )
    infinite = F.lit(float("inf"))
    return (
        F.when(has(_NAN) | (has(_PLUS) & has(_MINUS)), F.lit(float("nan")))
        .when(has(_PLUS), infinite)
        .when(has(_MINUS), -infinite)
        .otherwise(total)
    )


def mean_of(count: Column, sums: Column) -> Column:
    """The mean, null of no values."""
    return F.when(count > 0, sum_of(sums) / count)
