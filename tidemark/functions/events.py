"""Click-stream event expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def event_time(text: Column, ingested_at: Column) -> Column:
    """ISO text (also with Z) to a timestamp. Absent or unreadable text takes the ingest time,
    which is a column, so a replay gives the same rows again."""
    return F.coalesce(F.try_to_timestamp(text), ingested_at)


def with_defaults(df: DataFrame, ingested_at: Column) -> DataFrame:
    """Decoded wire events -> typed events: event_type, ts and date_partition are always set."""
    ts = event_time(F.col("timestamp"), ingested_at)
    return (
        df.withColumn("ts", ts)
        .withColumns(
            {
                "event_id": F.coalesce(
                    F.when(F.col("event_id") != "", F.col("event_id")),
                    stable_event_id(
                        "user_id", "session_id", "event_type", "event_name", "properties", "url", "timestamp"
                    ),
                ),
                "event_type": F.coalesce("event_type", F.lit("unknown")),
                "date_partition": F.coalesce(
                    F.when(F.col("date_partition") != "", F.col("date_partition")),
                    date_partition(F.col("ts")),
                ),
            }
        )
        .drop("timestamp")
    )


def stable_event_id(*names: str) -> Column:
    """An id from the row's own content: the same row gets the same id on every run."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("\u0000")) for n in names]
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32))


def date_partition(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def event_time_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def event_key(user_id: Column, event_id: Column) -> Column:
    """Partitioning key: the user when there is one (0 counts as none), else the event."""
    return F.when(user_id.isNotNull() & (user_id != 0), user_id.cast("string")).otherwise(event_id)


def has_user(user_id: Column) -> Column:
    return user_id.isNotNull()


def has_session(session_id: Column) -> Column:
    return F.coalesce(F.trim(session_id) != "", F.lit(False))


def is_page_view(event_type: Column) -> Column:
    return event_type == "page_view"


def is_purchase(event_type: Column) -> Column:
    return event_type == "purchase"


def is_error(event_type: Column) -> Column:
    return event_type == "error"


def get_property(properties: Column, key: str, default=None) -> Column:
    found = F.get_json_object(properties, f"$.{key}")
    return found if default is None else F.coalesce(found, F.lit(default))


def purchase_amount(event_type: Column, properties: Column, key: str = "amount") -> Column:
    """The amount of a purchase; 0.0 for other events and for a missing or zero amount."""
    amount = get_property(properties, key).try_cast("double")
    return F.when(is_purchase(event_type), F.coalesce(amount, F.lit(0.0))).otherwise(F.lit(0.0))


def with_session_id(df: DataFrame, session_id: Column) -> DataFrame:
    return df.withColumn("session_id", session_id)


def with_timestamp(df: DataFrame, ts: Column) -> DataFrame:
    """Replace the event time; the date follows it."""
    return df.withColumn("ts", ts).withColumn("date_partition", date_partition(F.col("ts")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def event_json() -> Column:
    """A typed event as JSON text with an ISO timestamp; properties are an object of texts."""
    return F.to_json(
        F.struct(
            "event_id",
            "user_id",
            "session_id",
            "event_type",
            "event_name",
            F.from_json("properties", "map<string,string>").alias("properties"),
            "url",
            "country",
            "city",
            iso(F.col("ts")).alias("timestamp"),
            "date_partition",
        ),
        {"ignoreNullFields": "false"},
    )


def session_json() -> Column:
    """A session row as JSON text; the country set becomes a sorted list."""
    return F.to_json(
        F.struct(
            "session_id",
            "user_id",
            iso(F.col("start_time")).alias("start_time"),
            iso(F.col("end_time")).alias("end_time"),
            "duration_seconds",
            "event_count",
            "page_view_count",
            "unique_urls_count",
            F.sort_array("countries").alias("countries"),
            "landing_page",
            "exit_page",
            "is_bounce",
            "device_type",
            "browser",
            "date_partition",
        ),
        {"ignoreNullFields": "false"},
    )


def hour_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00:00")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double; 0.0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def whole_seconds_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end).cast("long")


def is_product_page(url: Column) -> Column:
    return url.like("%/product/%")


def synthetic_session_id(session_id: Column, user_id: Column, start: Column) -> Column:
    """session_{user}_{epoch seconds} where the session has no id of its own."""
    made = F.concat_ws("_", F.lit("session"), user_id.cast("string"), F.unix_seconds(start).cast("string"))
    return F.when(session_id != "", session_id).otherwise(made)
