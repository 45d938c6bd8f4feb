"""Row types. Every reader uses one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire contract.
ORDER_CREATED = "order_created"
ORDER_CANCELLED = "order_cancelled"
ORDER_EVENT_TYPES = (ORDER_CREATED, ORDER_CANCELLED)

MONEY = T.DecimalType(18, 2)
# Sums of MONEY: wide enough for 10^20 rows of the largest amount.
MONEY_SUM = T.DecimalType(38, 2)

# One JSON object per line; money travels as text so no float ever touches it.
ORDER_WIRE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_time_ms", T.LongType()),
    ]
)

# What lies in the lake and in the fresh tier.
ORDER_ROW = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("order_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("amount", MONEY, False),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("event_time", T.TimestampType(), False),
    ]
)

# A record as a partitioned log hands it over.
LOG_RECORD = T.StructType(
    [
        T.StructField("partition_id", T.IntegerType(), False),
        T.StructField("offset_id", T.LongType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)

# Click-stream event on the wire; properties stay JSON text.
EVENT_WIRE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("date_partition", T.StringType()),
    ]
)

# One entry of an ingest request; a batch request wraps an array of them.
INGEST_EVENT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

INGEST_BATCH = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("events", T.ArrayType(INGEST_EVENT)),
    ]
)
