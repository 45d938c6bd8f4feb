"""Event streams derived from the stored tables.

`order_events` turns an orders table into immutable created / cancelled events with bounded
disorder; `clickstream` turns the raw events table into typed click-stream events. Both are
narrow transformations: one scan, no shuffle, usable on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.orders import wire_json
from tidemark.schemas import MONEY, ORDER_CANCELLED, ORDER_CREATED

# Fixed values of the derived event log.
START_MS = 1_700_000_000_000
PARTITIONS = 4
LATENESS_MS = 1000
CANCEL_TENTHS = 3
CANCEL_DELAY_ORDERS = 50
JITTER_STRIDE = 7919

# Fixed values of the derived click stream.
EVENT_TYPE_NAMES = {"view": "page_view", "click": "add_to_cart", "signup": "checkout"}
COUNTRY_CODES = ("US", "DE", "FR", "JP", "BR")
USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0",
    "Mozilla/5.0 (Linux; Android 13; Tablet) Chrome/119.0",
    "Mozilla/5.0 (iPad; CPU OS 17_0) Safari/604.1",
    "Mozilla/5.0 (X11; Linux) Firefox/121.0",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edge/120.0",
)


def order_events(orders: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """One creation per order and a cancellation for 3 of 10, on the same log partition.

    `emission` is the order in which the log received the events; event time strays from it by
    less than the lateness window. A cancellation always follows its creation.
    """
    k = F.col("o_orderkey")

    def event(prefix: str, event_type: str, emission: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), k.cast("string")).alias("event_id"),
            F.lit(event_type).alias("event_type"),
            emission.alias("emission"),
        )

    cancelled = F.when(
        k % 10 < CANCEL_TENTHS, event("x-", ORDER_CANCELLED, 2 * (k + CANCEL_DELAY_ORDERS) + 1)
    )
    entries = F.array(event("c-", ORDER_CREATED, 2 * k), cancelled)
    return (
        orders.select("o_orderkey", "o_custkey", "o_totalprice", F.explode(entries).alias("e"))
        .where(F.col("e").isNotNull())
        .select(
            "e.event_id",
            k.cast("string").alias("order_id"),
            "e.event_type",
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            F.col("o_custkey").alias("user_id"),
            (
                F.lit(START_MS) + F.col("e.emission") + (F.col("e.emission") * JITTER_STRIDE) % LATENESS_MS
            ).alias("event_time_ms"),
            (k % partitions).cast("int").alias("partition_id"),
            "e.emission",
        )
    )


def wire_lines(events: DataFrame) -> DataFrame:
    """Log records (key, value) of order events. Every 97th order sends a cut-off line and
    every 101st an event type nobody knows, so that decoding has something to reject."""
    k = F.col("order_id").cast("long")
    odd = events.withColumn(
        "event_type", F.when(k % 101 == 100, F.lit("order_refunded")).otherwise(F.col("event_type"))
    )
    text = wire_json()
    value = F.when(k % 97 == 96, F.substring(text, 1, 25)).otherwise(text)
    return odd.select("partition_id", "emission", F.col("order_id").alias("key"), value.alias("value"))


def clickstream(events: DataFrame, pages: bool = True) -> DataFrame:
    """Typed click-stream events; every sixth user has no country.

    The page columns (event_name, properties, url) come out of the JSON column. It is parsed
    once per row, by a generator, so that filters on url do not call the parser again;
    `pages=False` leaves these columns out and with them the JSON column out of the scan.
    """
    u = F.col("user_id")
    event_type = F.col("event_type")
    for raw, name in EVENT_TYPE_NAMES.items():
        event_type = F.when(F.col("event_type") == raw, name).otherwise(event_type)
    country = F.get(F.array(*[F.lit(c) for c in COUNTRY_CODES]), (u % 6).cast("int"))
    ts = F.col("ts").cast("timestamp")
    day = F.date_format(ts, "yyyy-MM-dd")
    columns = {
        "event_id": F.col("event_id").cast("string"),
        "user_id": u,
        "session_id": F.concat_ws("-", u.cast("string"), day),
        "event_type": event_type,
        "country": country,
        "city": F.when(country.isNotNull(), F.concat_ws("-", country, (u % 5).cast("string"))),
        "ts": ts,
        "date_partition": day,
        "value": F.col("value"),
    }
    if not pages:
        return events.select(*[c.alias(name) for name, c in columns.items()])
    made = F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))
    parsed = events.select("event_id", "user_id", "event_type", "ts", "value", F.inline(F.array(made)))
    k = F.col("k")
    agent = F.get(F.array(*[F.lit(a) for a in USER_AGENTS]), k % 6)
    columns |= {
        "event_name": F.when(k % 3 != 0, F.concat(F.lit("e"), (k % 5).cast("string"))),
        "properties": F.concat(
            F.lit('{"k":'),
            k.cast("string"),
            F.coalesce(F.concat(F.lit(',"user_agent":"'), agent, F.lit('"')), F.lit("")),
            F.lit("}"),
        ),
        "url": F.concat(F.when(k % 2 == 0, "/product/").otherwise("/page/"), k.cast("string")),
    }
    return parsed.select(*[c.alias(name) for name, c in columns.items()])
