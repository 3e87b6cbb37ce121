"""Bounded selections from tables of any size.

An ordered limit sends that many rows from every task to one place. Here one aggregate finds the
cut first, so hardly more rows leave the tasks than are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a doubling at which a cut may lie.
_STEPS = 16


def highest(df: DataFrame, score: str, most: int) -> DataFrame:
    """The rows with the highest ``score`` (above 0), ``most`` at most: all down to the step of a
    sixteenth of a doubling at which they would become too many. Rows with close scores stay or
    go together, so no order decides between equals."""
    step = F.floor(F.log2(F.col(score)) * _STEPS).cast("int")
    counts = df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()
    cut, kept = None, 0
    for row in sorted(counts, key=lambda r: -r["step"]):
        kept += row["rows"]
        if kept > most:
            break
        cut = row["step"]
    return df.where(F.lit(False) if cut is None else step >= cut)


def sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows: those with the smallest hashes ``key``. Small tables stay whole."""
    share = F.pmod(key, F.lit(1 << 53)) / F.lit(float(1 << 53))
    total = df.count()
    if total <= most:
        return df
    # A little more than are wanted, so that the exact cut below is left with few.
    return df.where(share < 1.1 * most / total).orderBy(share, key).limit(most)
