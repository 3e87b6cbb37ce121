"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN_POLICIES = ("skip", "propagate")


def grid_mean(values: Column) -> Column:
    """Unweighted mean of a grid, without missing points (null or NaN); null if none is left.

    The array is folded in place: no exploded rows and no exchange. A missing point turns the
    plain sum into null or NaN; only then is the grid filtered and summed again.
    """

    def plain_mean(grid: Column) -> Column:
        total = F.aggregate(grid, F.lit(0.0), lambda acc, x: acc + x)
        return total / F.nullif(F.size(grid), F.lit(0))

    grid = values.cast("array<double>")
    # NaN sorts above every number, so one comparison drops both kinds of missing point. The
    # array of one lets the filtered grid be used twice and computed once.
    present = F.array(F.filter(grid, lambda x: x < F.lit(float("nan"))))
    filtered_mean = F.get(F.transform(present, plain_mean), F.lit(0))
    return F.coalesce(F.nanvl(plain_mean(grid), filtered_mean), filtered_mean)


def nan_as_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def apply_nan_policy(value: Column, policy: str) -> Column:
    """``skip``: NaN does not take part. ``propagate``: NaN counts as above every number, so it
    shows in max and avg but not in min."""
    if policy not in NAN_POLICIES:
        raise ValueError(f"nan_policy must be one of {NAN_POLICIES}, not {policy!r}")
    return nan_as_null(value) if policy == "skip" else value
