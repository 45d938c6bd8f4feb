"""Log records and JSON lines: decode, split off what cannot be decoded, range reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.orders import wire_json
from tidemark.schemas import EVENT_WIRE, LOG_RECORD, MONEY, ORDER_EVENT_TYPES, ORDER_WIRE


def starting_offsets(topic: str, next_offsets: dict[int, int] | None, partitions: int | None = None) -> str:
    """Where to start: the committed next offset of every partition, -2 (the beginning) for
    partitions nobody has committed."""
    if not next_offsets:
        return "earliest"
    known = {p: -2 for p in range(partitions or 0)} | next_offsets
    return json.dumps({topic: {str(p): o for p, o in sorted(known.items())}})


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    next_offsets: dict[int, int] | None = None,
    partitions: int | None = None,
    max_per_trigger: int | None = None,
) -> DataFrame:
    """A topic from explicit offsets.

    Offsets come from the lake's last commit, never from a consumer group. The connector
    ships separately from Spark and must be on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets(topic, next_offsets, partitions))
        .option("failOnDataLoss", "true")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return _log_columns(reader.load())


def kafka_range(
    spark: SparkSession, servers: str, topic: str, start_ms: int = 0, end_ms: int | None = None
) -> DataFrame:
    """The bounded read: one timestamp range of a topic."""
    reader = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingTimestamp", start_ms)
    )
    if end_ms is not None:
        reader = reader.option("endingTimestamp", end_ms)
    return _log_columns(reader.load())


def _log_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("partition").alias("partition_id"),
        F.col("offset").alias("offset_id"),
        F.col("value").cast("string").alias("value"),
    )


def log_file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A log kept as Parquet files of (partition_id, offset_id, value) below `path`, oldest first."""
    reader = spark.readStream.schema(LOG_RECORD).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def in_time_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """[start, end) on a typed timestamp column, so file statistics can skip."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def parse_once(lines: DataFrame, value: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """All columns plus the fields of the JSON text.

    The parsed struct is unfolded with `inline`, not selected: a later filter on a field then
    stays above the parser instead of being rewritten into further calls of it.
    """
    return lines.select("*", F.inline(F.array(F.from_json(F.col(value), schema, options))))


def decode_orders(lines: DataFrame, value: str = "value") -> DataFrame:
    """All input rows with the typed event and `reject_reason` (NULL where the row is good).

    A broken line does not stop anything: it keeps its text and gets a reason.
    """
    names = ORDER_WIRE.names
    schema = T.StructType([*ORDER_WIRE.fields, T.StructField("_broken", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    kept = lines.drop(*names)
    parsed = parse_once(kept, value, schema, options)
    amount = F.col("amount").try_cast(MONEY)
    exact = F.col("amount").try_cast("decimal(38,18)") == amount
    absent = F.lit(False)
    for name in names:
        absent = absent | F.col(name).isNull()
    reason = (
        F.when(F.col("_broken").isNotNull() | (F.trim(F.coalesce(value, F.lit(""))) == ""), "malformed_json")
        .when(absent, "missing_field")
        .when(~F.col("event_type").isin(*ORDER_EVENT_TYPES), "unknown_event_type")
        .when(amount.isNull() | ~F.coalesce(exact, F.lit(False)), "bad_amount")
    )
    return parsed.select(
        *kept.columns,
        reason.alias("reject_reason"),
        "event_id",
        "order_id",
        "event_type",
        amount.alias("amount"),
        "user_id",
        "event_time_ms",
    )


def accepted(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.where(F.col("reject_reason").isNull()).drop("reject_reason", value)


def quarantine(decoded: DataFrame) -> DataFrame:
    """Rejected rows with their original text and position."""
    typed = ("event_id", "order_id", "event_type", "amount", "user_id", "event_time_ms")
    return decoded.where(F.col("reject_reason").isNotNull()).drop(*typed)


def decode_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Click-stream JSON -> EVENT_WIRE columns; use functions.events.with_defaults next."""
    return parse_once(lines, value, EVENT_WIRE, {}).drop(value)


def read_order_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of order events; blank lines are skipped, anything broken fails the read."""
    return (
        spark.read.schema(ORDER_WIRE)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("amount", F.col("amount").cast(MONEY))
    )


def write_order_lines(events: DataFrame, path: str) -> None:
    """The ground-truth file: one compact JSON object per line."""
    events.select(wire_json().alias("value")).write.text(path)
