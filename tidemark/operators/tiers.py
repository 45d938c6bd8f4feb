"""Storage tiers by age, keyed values with a lifetime, routed replay, retention."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT, WARM, COLD = "kafka", "clickhouse", "cold_storage"


@dataclass(frozen=True)
class RetentionPolicy:
    """How long each tier keeps data. A month counts 30 days."""

    hot_days: int = 7
    warm_months: int = 12
    cold_years: int = 7

    def hot_cutoff(self, as_of: dt.datetime) -> dt.datetime:
        return as_of - dt.timedelta(days=self.hot_days)

    def warm_cutoff(self, as_of: dt.datetime) -> dt.datetime:
        return as_of - dt.timedelta(days=self.warm_months * 30)


def retention_status(spark: SparkSession, policy: RetentionPolicy, as_of: dt.datetime) -> DataFrame:
    return spark.range(1).select(
        F.lit(policy.hot_days).alias("kafka_retention_days"),
        F.lit(policy.warm_months).alias("clickhouse_retention_months"),
        F.lit(policy.cold_years).alias("cold_storage_retention_years"),
        F.lit(f"Recent {policy.hot_days} days").alias("kafka_covers"),
        F.lit(f"Last {policy.warm_months} months").alias("clickhouse_covers"),
        F.lit(f"Last {policy.cold_years} years").alias("cold_storage_covers"),
        F.lit(policy.hot_cutoff(as_of).isoformat()).alias("kafka_cutoff"),
        F.lit(policy.warm_cutoff(as_of).isoformat()).alias("clickhouse_cutoff"),
    )


def tier_of(ts: Column, policy: RetentionPolicy, as_of: dt.datetime) -> Column:
    """The tier that answers for an event of this age."""
    return (
        F.when(ts >= F.lit(policy.hot_cutoff(as_of)), HOT)
        .when(ts >= F.lit(policy.warm_cutoff(as_of)), WARM)
        .otherwise(COLD)
    )


def range_scan(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """[start, end) of a tier; unordered, so that the plan stays a scan."""
    return events.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))


def ordered_range(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The same in time order: range partitions by (ts, event_id), each sorted on its own."""
    return range_scan(events, start, end).orderBy("ts", "event_id")


def archive_scan(archive: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Day folders first (whole days, pruned before listing files), then exact times."""
    days = F.col("date_partition").between(start.strftime("%Y-%m-%d"), end.strftime("%Y-%m-%d"))
    return range_scan(archive.where(days), start, end)


def replay(
    hot: DataFrame,
    warm: DataFrame,
    cold: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    policy: RetentionPolicy,
    as_of: dt.datetime,
) -> DataFrame:
    """Events of [start, end), each from exactly one tier: the three ranges do not overlap.

    A tier whose range is empty is not read at all.
    """
    kc, wc = policy.hot_cutoff(as_of), policy.warm_cutoff(as_of)
    parts = [
        (HOT, hot, range_scan, max(start, kc), end),
        (WARM, warm, range_scan, max(start, wc), min(end, kc)),
        (COLD, cold, archive_scan, start, min(end, wc)),
    ]
    chosen = [scan(df, a, b).withColumn("source", F.lit(name)) for name, df, scan, a, b in parts if a < b]
    if not chosen:
        return hot.where(F.lit(False)).withColumn("source", F.lit(HOT))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def replay_totals(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("source").agg(F.count(F.lit(1)).alias("events"))


def expire(events: DataFrame, policy: RetentionPolicy, as_of: dt.datetime) -> DataFrame:
    """What retention keeps. Whole days before the cutoff go by their partition value."""
    cutoff = policy.warm_cutoff(as_of)
    kept = events.where(F.col("ts") >= F.lit(cutoff))
    if "date_partition" in events.columns:
        kept = kept.where(F.col("date_partition") >= cutoff.strftime("%Y-%m-%d"))
    return kept


def warm_rows(events: DataFrame) -> DataFrame:
    """The eleven columns of the warm table; absent text becomes '' and properties '{}'."""
    text = ["event_id", "session_id", "event_type", "event_name", "url", "country", "city"]
    filled = events.withColumns({c: F.coalesce(c, F.lit("")) for c in text}).withColumn(
        "properties", F.coalesce("properties", F.lit("{}"))
    )
    return filled.select(
        "event_id",
        "user_id",
        "session_id",
        "event_type",
        "event_name",
        "properties",
        "url",
        "country",
        "city",
        "ts",
        "date_partition",
    )


def archive_rows(events: DataFrame) -> DataFrame:
    """Archive layout: folders by event date and event hour."""
    return events.withColumns(
        {"date_partition": F.date_format("ts", "yyyy-MM-dd"), "hour": F.date_format("ts", "HH")}
    )


def write_archive(events: DataFrame, path: str) -> None:
    """One shuffle by folder. Rebalancing joins small folders' rows into one task and cuts a hot
    folder into several, so files stay of a useful size either way."""
    rows = archive_rows(events).hint("rebalance", "date_partition", "hour")
    rows.write.partitionBy("date_partition", "hour").json(path)


def latest_values(puts: DataFrame, key: str, value: Column, put_time: str, ttl: Column | None = None) -> DataFrame:
    """The last write of every key with its expiry (NULL: never)."""
    expiry = F.lit(None).cast("timestamp") if ttl is None else F.timestamp_micros(
        F.unix_micros(put_time) + ttl.cast("long") * 1_000_000
    )
    version = F.struct(F.col(put_time).alias("put_time"), expiry.alias("expires_at"), value.alias("value"))
    order = F.struct(F.col(put_time), value)
    return puts.groupBy(key).agg(F.max_by(version, order).alias("v")).select(key, "v.*")


def alive(values: DataFrame, as_of: Column) -> DataFrame:
    return values.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def lookup(values: DataFrame, key: str, keys: list | DataFrame) -> DataFrame:
    """Values of the given keys; a key that is not there yields no row.

    A list becomes a pushed-down IN filter. Keys in a table are semi-joined; Spark picks a
    broadcast only if the measured size allows it.
    """
    if isinstance(keys, DataFrame):
        return values.join(keys.select(key), key, "left_semi")
    return values.where(F.col(key).isin(*keys))


def without_keys(values: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Delete by key."""
    return values.join(keys.select(key), key, "left_anti")


def deleted_flags(values: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Per requested key whether there was anything to delete."""
    there = values.select(key).distinct().withColumn("deleted", F.lit(True))
    return keys.select(key).distinct().join(there, key, "left").withColumn(
        "deleted", F.coalesce("deleted", F.lit(False))
    )


def sorted_set(adds: DataFrame, key: str, member: str, score: str, added_at: str) -> DataFrame:
    """Latest score of every member of a key."""
    return adds.groupBy(key, member).agg(F.max_by(score, F.struct(added_at, score)).alias(score))
