"""Totals over history and fresh data, split on one watermark so that every event counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.orders import at_or_above, below, gmv_delta, gmv_sum
from tidemark.schemas import MONEY_SUM, ORDER_CREATED



def lake_side(lake: DataFrame, t_ms: int) -> DataFrame:
    return lake.where(below(F.col("event_time"), t_ms)).agg(*_totals())


def fresh_side(fresh: DataFrame, t_ms: int) -> DataFrame:
    return fresh.where(at_or_above(F.col("event_time"), t_ms)).agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        gmv_sum(F.col("event_type"), F.col("amount")).alias("gmv"),
    ]


def seam_totals(lake: DataFrame, fresh: DataFrame, t_ms: int) -> DataFrame:
    """History below T plus fresh data at or above T, as one row.

    T is read once by the caller and used on both sides; each filter reaches its own scan, and
    both sides meet in a single aggregate.
    """
    columns = ["event_type", "amount"]
    tagged = (
        lake.where(below(F.col("event_time"), t_ms))
        .select(*columns, F.lit(True).alias("in_lake"))
        .unionByName(
            fresh.where(at_or_above(F.col("event_time"), t_ms)).select(
                *columns, F.lit(False).alias("in_lake")
            )
        )
    )
    delta = gmv_delta(F.col("event_type"), F.col("amount"))

    def money(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, delta)), F.lit(0)).cast(MONEY_SUM)

    in_lake, in_fresh = F.col("in_lake"), ~F.col("in_lake")
    return tagged.agg(
        F.lit(t_ms).cast("long").alias("watermark_t_ms"),
        F.count(F.lit(1)).alias("count"),
        money(F.lit(True)).alias("gmv"),
        F.count_if(in_lake).alias("lake_count"),
        F.count_if(in_fresh).alias("ch_count"),
        money(in_lake).alias("lake_gmv"),
        money(in_fresh).alias("ch_gmv"),
    )


def seam_json(result: DataFrame) -> DataFrame:
    """The totals as one JSON record; money as text."""
    money = {"gmv", "lake_gmv", "ch_gmv"}
    fields = [F.col(c).cast("string").alias(c) if c in money else F.col(c) for c in result.columns]
    return result.select(F.to_json(F.struct(*fields)).alias("value"))


def event_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == ORDER_CREATED).alias("created"),
        F.count_if(F.col("event_type") != ORDER_CREATED).alias("cancelled"),
        gmv_sum(F.col("event_type"), F.col("amount")).alias("gmv"),
    )


def ground_truth(events: DataFrame, t_ms: int) -> DataFrame:
    """Expected totals straight from the source events, never through the landed tables."""
    early = F.col("event_time_ms") < t_ms
    delta = gmv_delta(F.col("event_type"), F.col("amount"))
    return events.agg(
        F.count(F.lit(1)).alias("count"),
        gmv_sum(F.col("event_type"), F.col("amount")).alias("gmv"),
        F.count_if(early).alias("count_below_t"),
        F.coalesce(F.sum(F.when(early, delta)), F.lit(0)).cast(MONEY_SUM).alias("gmv_below_t"),
    )


def ids_below(events: DataFrame, t_ms: int) -> DataFrame:
    return events.where(F.col("event_time_ms") < t_ms).select("event_id")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.col("event_id")).alias("distinct_ids")
    )
