"""Dense positions inside groups of any size.

A plain row_number sorts a whole group in one task. Here a group is cut into ranges of the
order column first; each range is numbered on its own and starts where the earlier ranges of
its group end. The result is the same number, and a group that holds most of the table is
spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(number: Column, width: int) -> Column:
    """floor(number / width) in whole numbers, also below zero."""
    return F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))


def with_position(
    df: DataFrame, group: list[str], order: list[Column], cut: Column, name: str = "position"
) -> DataFrame:
    """Add `name`: 0, 1, 2, ... by `order` inside `group`.

    `cut` is an integer that never decreases along `order` (a time bucket, a key range).
    """
    ranged = df.withColumn("_cut", cut)
    keys = [*group, "_cut"]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    earlier = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        ranged.withColumn("_local", local)
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_cut", "_local", "_start", *[f"_k_{k}" for k in keys])
    )


def with_log_offsets(events: DataFrame, range_width: int = 1 << 18) -> DataFrame:
    """Give every event the offset its log partition would have given it."""
    return with_position(
        events, ["partition_id"], [F.col("emission")], bucket(F.col("emission"), range_width), "offset_id"
    )


def assign_partition(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Keyed publishing: equal keys always meet in the same partition."""
    return df.withColumn("partition_id", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
