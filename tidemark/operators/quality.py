"""Set comparison, order lifecycle, duplicates, late rows, drift, skew, distinct estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.orders import gmv_delta, gmv_sum
from tidemark.schemas import MONEY_SUM, ORDER_CANCELLED, ORDER_CREATED


def compare_ids(truth: DataFrame, landed: DataFrame, key: str = "event_id") -> DataFrame:
    """Every id with how often it occurs on either side.

    One shuffle of partly counted ids instead of two anti joins, and duplicates show as well.
    """
    tagged = truth.select(key, F.lit(1).alias("t"), F.lit(0).alias("l")).unionByName(
        landed.select(key, F.lit(0).alias("t"), F.lit(1).alias("l"))
    )
    return tagged.groupBy(key).agg(F.sum("t").alias("in_truth"), F.sum("l").alias("in_landed"))


def set_difference(truth: DataFrame, landed: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids missing from, spurious in or duplicated in the landed set; no rows when equal."""
    c = compare_ids(truth, landed, key)
    problem = (
        F.when(F.col("in_landed") == 0, "missing")
        .when(F.col("in_truth") == 0, "spurious")
        .when(F.col("in_landed") > F.col("in_truth"), "duplicate")
        .when(F.col("in_landed") < F.col("in_truth"), "missing")
    )
    return c.withColumn("problem", problem).where(F.col("problem").isNotNull())


def set_summary(truth: DataFrame, landed: DataFrame, key: str = "event_id") -> DataFrame:
    return compare_ids(truth, landed, key).agg(
        F.count_if((F.col("in_truth") > 0) & (F.col("in_landed") > 0)).alias("common"),
        F.count_if(F.col("in_landed") == 0).alias("missing"),
        F.count_if(F.col("in_truth") == 0).alias("spurious"),
        F.count_if(F.col("in_landed") > 1).alias("duplicated"),
    )


def order_lifecycle(events: DataFrame) -> DataFrame:
    """Creation and cancellation of an order side by side, and its status now."""
    created = F.col("event_type") == ORDER_CREATED
    cancelled = F.col("event_type") == ORDER_CANCELLED
    return events.groupBy("order_id").agg(
        F.min(F.when(created, F.col("event_time_ms"))).alias("created_ms"),
        F.max(F.when(cancelled, F.col("event_time_ms"))).alias("cancelled_ms"),
        F.coalesce(F.sum(gmv_delta(F.col("event_type"), F.col("amount"))), F.lit(0))
        .cast(MONEY_SUM)
        .alias("net_amount"),
        F.when(F.max(cancelled), ORDER_CANCELLED).otherwise(ORDER_CREATED).alias("status"),
    )


def deduplicate(events: DataFrame, key: str, order: Column) -> DataFrame:
    """The first copy of every id. Copies combine map-side, so a much repeated id is no hot spot."""
    whole = F.struct(*events.columns)
    return events.groupBy(key).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def split_late(arrivals: DataFrame, t_at_arrival: str = "t_at_arrival_ms") -> tuple[DataFrame, DataFrame]:
    """(in time, late): late rows lie below the watermark that was published when they came.

    A row without event time or without a watermark is not late, so no row is in neither part.
    """
    late = F.coalesce(F.col("event_time_ms") < F.col(t_at_arrival), F.lit(False))
    return arrivals.where(~late), arrivals.where(late)


def late_summary(arrivals: DataFrame, t_at_arrival: str = "t_at_arrival_ms") -> DataFrame:
    _, late = split_late(arrivals, t_at_arrival)
    return late.agg(
        F.count(F.lit(1)).alias("late_events"),
        gmv_sum(F.col("event_type"), F.col("amount")).alias("late_gmv"),
    )


def daily_totals(events: DataFrame, prefix: str) -> DataFrame:
    return events.groupBy(F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"),
        gmv_sum(F.col("event_type"), F.col("amount")).alias(f"{prefix}_gmv"),
    )


def reconcile_daily(fresh: DataFrame, lake: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Daily totals of both tables side by side; `alert` where they differ by more than 0.1 %.

    Both sides are aggregated before they meet, so the join sees one row per day.
    """
    both = daily_totals(fresh, "fresh").join(daily_totals(lake, "lake"), "day", "full_outer")
    filled = both.na.fill(0, ["fresh_count", "lake_count"]).withColumns(
        {c: F.coalesce(c, F.lit(0).cast(MONEY_SUM)) for c in ("fresh_gmv", "lake_gmv")}
    )

    def drift(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return F.when(y != 0, F.abs(x - y) / F.abs(y)).when(x != 0, F.lit(1.0)).otherwise(F.lit(0.0))

    return (
        filled.withColumn("count_drift", drift("fresh_count", "lake_count"))
        .withColumn("gmv_drift", drift("fresh_gmv", "lake_gmv"))
        .withColumn("alert", (F.col("count_drift") > tolerance) | (F.col("gmv_drift") > tolerance))
    )


def salted_totals(events: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Count and sum per key through a salted first step.

    Map-side combining already flattens a hot key for these two numbers; the salt also splits
    the merge of a key that occurs in every one of very many tasks.
    """
    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts))
    delta = gmv_delta(F.col("event_type"), F.col("amount"))
    return (
        events.groupBy(key, salt.alias("_salt"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(delta).alias("g"))
        .groupBy(key)
        .agg(F.sum("n").alias("events"), F.sum("g").cast(MONEY_SUM).alias("gmv"))
    )


def partition_skew(events: DataFrame, partition: str = "partition_id") -> DataFrame:
    """Rows and newest event time per log partition, with how far each lags the newest."""
    per = events.groupBy(partition).agg(
        F.count(F.lit(1)).alias("events"), F.max("event_time_ms").alias("max_event_time_ms")
    )
    newest = per.agg(F.max("max_event_time_ms").alias("m")).select("m").scalar()
    return per.withColumn("lag_ms", newest - F.col("max_event_time_ms"))


def distinct_users(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Exact and sketched number of different users per window, with the relative error."""
    out = events.groupBy(F.window("ts", size).alias("w")).agg(
        F.count_distinct("user_id").alias("exact_users"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("estimated_users"),
    )
    error = F.abs(F.col("estimated_users") - F.col("exact_users")) / F.col("exact_users")
    return out.select(
        F.col("w.start").alias("window_start"), "exact_users", "estimated_users", error.alias("relative_error")
    )


#: log2 of a sketch's registers; one register is a byte, so a pane never takes more than 4 KB and a header.
LG_REGISTERS = 12


def user_panes(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """A distinct-count sketch for each window and country: pane, country, sketch, events.

    Panes are stored once and united over any range later, so no range reads the events again.
    """
    return (
        events.groupBy(F.window("ts", size).alias("w"), "country")
        .agg(F.hll_sketch_agg("user_id", F.lit(LG_REGISTERS)).alias("sketch"), F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("pane"), "country", "sketch", "events")
    )


def users_over(panes: DataFrame, size: str, slide: str) -> DataFrame:
    """Estimated users, events, panes and bytes read for each sliding range and country.

    A pane is copied into the ranges it belongs to as a few kilobytes at most; events are not.
    """
    return (
        panes.groupBy(F.window("pane", size, slide).alias("w"), "country")
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_users"),
            F.sum("events").alias("events"),
            F.count(F.lit(1)).alias("panes"),
            F.max(F.octet_length("sketch")).alias("largest_pane_bytes"),
        )
        .select(F.col("w.start").alias("window_start"), "country", "estimated_users", "events", "panes", "largest_pane_bytes")
    )
