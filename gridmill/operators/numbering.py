"""Dense row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.sources.scratch import materialize


def number_rows(
    df: DataFrame,
    group: str,
    order_by: Sequence[str],
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add ``name``, the 0-based rank within ``group`` (never null) by ``order_by`` (unique in it).

    A window over ``group`` would sort a whole group in one task. Here a range partitioning on
    the full key splits even the largest group, each slice numbers its own sorted rows, and the
    small table of slice sizes turns slice numbers into group numbers. The numbered slices are
    written once, as both sides must see the same slice borders. ``slices`` defaults to
    ``spark.sql.shuffle.partitions``; adaptive execution does not split a slice later, so give
    more where rows are wide.
    """
    key = [group, *order_by]
    slot = F.col("_slot")
    # A generated id is 2**33 * partition + row in the partition, here in sort order.
    sliced = materialize(
        df.repartitionByRange(*([slices] if slices else []), *key)
        .sortWithinPartitions(*key)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright(slot, 33)),
        "numbered",
    )
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(group, "_slice")
        .agg(F.count("*").alias("rows"), F.min("_slot").alias("first"))
        .select(
            group,
            "_slice",
            (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"),
        )
    )
    shifts = materialize(shifts, "slice_shifts")
    return (
        sliced.join(shifts, [group, "_slice"])
        .withColumn(name, slot + F.col("_shift"))
        .drop("_slice", "_slot", "_shift")
    )
