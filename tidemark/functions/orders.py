"""Order-event expressions: signed money, wire text, event time, seam predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import MONEY, MONEY_SUM, ORDER_CANCELLED, ORDER_CREATED


def strict_gmv_delta(event_type: Column, amount: Column) -> Column:
    """+amount for a creation, -amount for a cancellation; any other type fails the job."""
    bad = F.raise_error(F.concat(F.lit("unknown event_type: "), event_type))
    return (
        F.when(event_type == ORDER_CREATED, amount)
        .when(event_type == ORDER_CANCELLED, -amount)
        .otherwise(bad.cast(MONEY))
    )


def gmv_delta(event_type: Column, amount: Column) -> Column:
    """Lenient form used on already decoded rows: whatever is not a creation counts negative."""
    return F.when(event_type == ORDER_CREATED, amount).otherwise(-amount)


def gmv_sum(event_type: Column, amount: Column) -> Column:
    """Exact GMV; 0 rather than NULL over no rows."""
    return F.coalesce(F.sum(gmv_delta(event_type, amount)), F.lit(0)).cast(MONEY_SUM)


def wire_json() -> Column:
    """Compact JSON text of an order event; money with two decimals as a string."""
    return F.to_json(
        F.struct(
            "event_id",
            "order_id",
            "event_type",
            F.col("amount").cast(MONEY).cast("string").alias("amount"),
            "user_id",
            "event_time_ms",
        )
    )


def event_time(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp without a detour through floating point."""
    return F.timestamp_millis(ms)


def utc_instant(ms: int) -> Column:
    """The same instant as a literal, so that file statistics and partitions can prune on it."""
    return F.lit(dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms))


def below(event_time_col: Column, t_ms: int) -> Column:
    return event_time_col < utc_instant(t_ms)


def at_or_above(event_time_col: Column, t_ms: int) -> Column:
    return event_time_col >= utc_instant(t_ms)
