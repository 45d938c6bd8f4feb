"""Validation rules, enrichment and metadata of incoming events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import date_partition, stable_event_id

# Field limits of an ingest request.
MAX_LENGTHS = {
    "event_type": 100,
    "event_name": 100,
    "url": 2048,
    "referrer": 2048,
    "user_agent": 512,
    "ip_address": 45,
    "country": 2,
    "city": 100,
}
MIN_BATCH_EVENTS = 1
MAX_BATCH_EVENTS = 1000


def reject_reasons(get: Callable[[str], Column] = F.col) -> Column:
    """Names of all broken rules; an empty array means the event is accepted. `get` finds a
    field: a column of the row, or a field of an array element."""
    rules = [
        F.when(get("event_type").isNull(), F.lit("event_type_missing")),
        F.when(F.length(get("event_type")) == 0, F.lit("event_type_empty")),
    ]
    rules += [
        F.when(F.length(get(name)) > limit, F.lit(f"{name}_too_long")) for name, limit in MAX_LENGTHS.items()
    ]
    return F.array_compact(F.array(*rules))


def batch_reject_reasons(events: Column) -> Column:
    """A batch needs 1..1000 events and every one of them must be valid; the reasons of an
    event carry its index."""
    n = F.coalesce(F.size(events), F.lit(0))
    size_rules = F.array_compact(
        F.array(
            F.when(n < MIN_BATCH_EVENTS, F.lit("batch_empty")),
            F.when(n > MAX_BATCH_EVENTS, F.lit("batch_too_large")),
        )
    )

    def of_event(e: Column, i: Column) -> Column:
        at = F.concat(F.lit("events["), i.cast("string"), F.lit("]: "))
        return F.transform(reject_reasons(e.getField), lambda r: F.concat(at, r))

    of_events = F.coalesce(F.flatten(F.transform(events, of_event)), F.array().cast("array<string>"))
    return F.concat(size_rules, of_events)


def enrich(df: DataFrame, received_at: Column, source: str, id_columns: list[str]) -> DataFrame:
    """Fill in what a request may leave out.

    `received_at` is a column of the request, not the wall clock, and the id is a hash of
    `id_columns`; both make a replayed request produce the same rows.
    """
    blank_session = F.coalesce(F.col("session_id"), F.lit("")) == ""
    made = F.concat(F.lit("session_"), F.unix_seconds(received_at).cast("string"))
    if source == "batch_api":
        made = F.concat(made, F.lit("_"), F.coalesce(F.col("user_id").cast("string"), F.lit("None")))
    blank_name = F.coalesce(F.col("event_name"), F.lit("")) == ""
    return df.withColumns(
        {
            "event_id": stable_event_id(*id_columns),
            "session_id": F.when(blank_session, made).otherwise(F.col("session_id")),
            "event_name": F.when(blank_name, F.col("event_type")).otherwise(F.col("event_name")),
            "ts": received_at,
            "date_partition": date_partition(received_at),
            "ingestion_timestamp": received_at,
            "source": F.lit(source),
        }
    )


def producer_stamp(df: DataFrame, sent_at: Column, producer_id: str | None = None) -> DataFrame:
    """Metadata of the sending side. A batch gets a batch id, a single event a producer id."""
    out = df.withColumn("producer_timestamp", F.unix_millis(sent_at))
    if producer_id is not None:
        return out.withColumn("producer_id", F.lit(producer_id))
    return out.withColumn("send_batch_id", F.concat(F.lit("batch_"), F.unix_seconds(sent_at).cast("string")))


def archive_stamp(df: DataFrame, archived_at: Column, retention_years: int = 7) -> DataFrame:
    return df.withColumns(
        {
            "archived_at": archived_at,
            "archive_version": F.lit("1.0"),
            "retention_policy": F.struct(
                F.lit("cold").alias("tier"), F.lit(retention_years).alias("retention_years")
            ),
        }
    )
