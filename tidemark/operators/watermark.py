"""Progress per log partition, and the safe watermark T that follows from it.

`partition_progress` reduces records to one row per partition, `merge_progress` adds it to what a
commit already states, and `safe_watermark` reads T off the merged rows. Landing, the seam and the
queries all use these three; there is no second form of the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_progress(records: DataFrame) -> DataFrame:
    """Next offset to read and largest event time, one row per log partition."""
    return records.groupBy("partition_id").agg(
        (F.max("offset_id") + 1).alias("next_offset"),
        F.max("event_time_ms").alias("max_event_time_ms"),
    )


def merge_progress(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Both numbers only ever grow; partitions without new rows keep what they had."""
    return (
        new.unionByName(previous)
        .groupBy("partition_id")
        .agg(
            F.max("next_offset").alias("next_offset"),
            F.max("max_event_time_ms").alias("max_event_time_ms"),
        )
    )


def watermark_of(
    max_by_partition: Column, partitions: Column, lateness_ms: int, previous_t_ms: int, expected: int | None
) -> Column:
    """T from the smallest per-partition maximum and the number of partitions heard from."""
    held = partitions == 0
    if expected is not None:
        held = held | (partitions < expected)
    prev = F.lit(previous_t_ms).cast("long")
    return F.when(held, prev).otherwise(F.greatest(prev, max_by_partition - lateness_ms))


def safe_watermark(
    progress: DataFrame, lateness_ms: int, previous_t_ms: int = 0, expected_partitions: int | None = None
) -> DataFrame:
    """One row: watermark_ms."""
    return progress.agg(
        watermark_of(
            F.min("max_event_time_ms"),
            F.count("max_event_time_ms"),
            lateness_ms,
            previous_t_ms,
            expected_partitions,
        ).alias("watermark_ms")
    )
