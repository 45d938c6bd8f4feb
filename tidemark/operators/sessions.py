"""User sessions closed by a pause.

On a table the work is done on slots: a slot is one user's events inside one gap-long stretch
of the clock. Events that share a slot are less than a gap apart, so they always share a
session, and a session break can only lie between two slots. Slots combine map-side, which
leaves at most (time span / gap) rows per user however many events the user has; only these
rows are ordered per user. On a stream `stream_sessions` uses Spark's session window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.agents import browser, device_type
from tidemark.functions.events import (
    day_text,
    get_property,
    is_page_view,
    ratio,
    synthetic_session_id,
    whole_seconds_between,
)
from tidemark.operators.rollup import keep
from tidemark.sources.offsets import bucket

GAP = "30 minutes"
MINUTE_US = 60_000_000
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def gap_micros(gap: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s+(second|minute|hour|day)s?", gap.strip()).groups()
    return int(number) * _UNITS[unit] * 1_000_000


def _user_events(events: DataFrame) -> DataFrame:
    """Only what sessions need; page is the URL of a page view, else NULL."""
    page = F.when(is_page_view(F.col("event_type")) & (F.col("url") != ""), F.col("url"))
    return keep(events, F.col("user_id").isNotNull()).select(
        "user_id",
        "ts",
        "event_id",
        "session_id",
        "event_type",
        page.alias("page"),
        F.when(F.col("country") != "", F.col("country")).alias("country"),
        get_property(F.col("properties"), "user_agent").alias("user_agent"),
    )


def _facts() -> list[Column]:
    """Everything about a stretch of events that merges. Each edge is one struct led by
    (ts, event_id), so the smallest or largest of two of them is the edge of both."""
    place = [F.col("ts"), F.col("event_id")]
    page = F.when(F.col("page").isNotNull(), F.struct(*place, "page"))
    agent = F.when(F.col("user_agent").isNotNull(), F.struct(*place, "user_agent"))
    return [
        F.min(F.struct(*place, "session_id")).alias("first"),
        F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_page_view(F.col("event_type"))).alias("page_view_count"),
        F.collect_set("country").alias("countries"),
        F.min(page).alias("landing"),
        F.max(page).alias("exit"),
        F.min(agent).alias("agent"),
    ]


def _merged_facts() -> list[Column]:
    return [
        F.min("first").alias("first"),
        F.max("end_time").alias("end_time"),
        F.sum("event_count").alias("event_count"),
        F.sum("page_view_count").alias("page_view_count"),
        F.array_distinct(F.flatten(F.collect_list("countries"))).alias("countries"),
        F.min("landing").alias("landing"),
        F.max("exit").alias("exit"),
        F.min("agent").alias("agent"),
    ]


def _derived(df: DataFrame) -> DataFrame:
    """Raw facts of a finished session -> the session record."""
    start, end = F.col("first.ts"), F.col("end_time")
    agent = F.col("agent.user_agent")
    optional = [c for c in ("session", "unique_urls_count", "opened") if c in df.columns]
    return df.select(
        *optional,
        synthetic_session_id(F.col("first.session_id"), F.col("user_id"), start).alias("session_id"),
        "user_id",
        start.alias("start_time"),
        end,
        whole_seconds_between(start, end).alias("duration_seconds"),
        "event_count",
        "page_view_count",
        F.sort_array("countries").alias("countries"),
        F.col("landing.page").alias("landing_page"),
        F.col("exit.page").alias("exit_page"),
        (F.col("page_view_count") <= 1).alias("is_bounce"),
        device_type(agent).alias("device_type"),
        browser(agent).alias("browser"),
        day_text(start).alias("date_partition"),
    )


def _slot(gap: str) -> Column:
    return bucket(F.unix_micros("ts"), gap_micros(gap))


def session_slots(events: DataFrame, gap: str = GAP) -> DataFrame:
    """One row per user and slot with the slot's facts and its session's number.

    A session that is exactly one gap silent goes on; anything longer starts a new one.
    """
    slots = _user_events(events).withColumn("slot", _slot(gap)).groupBy("user_id", "slot").agg(*_facts())
    in_order = Window.partitionBy("user_id").orderBy("slot")
    silence = F.unix_micros("first.ts") - F.unix_micros(F.lag("end_time").over(in_order))
    broken = F.when(silence > gap_micros(gap), 1).otherwise(0)
    return slots.withColumn("_broken", broken).withColumn("session_no", F.sum("_broken").over(in_order)).drop(
        "_broken"
    )


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Completed sessions of every user."""
    slots = session_slots(events, gap)
    whole = slots.groupBy("user_id", "session_no").agg(*_merged_facts())
    urls = (
        _slot_pages(events, gap)
        .join(slots.select("user_id", "slot", "session_no"), ["user_id", "slot"])
        .groupBy("user_id", "session_no")
        .agg(F.count_distinct("page").alias("unique_urls_count"))
    )
    joined = whole.join(urls, ["user_id", "session_no"], "left")
    return _derived(joined.withColumn("unique_urls_count", F.coalesce("unique_urls_count", F.lit(0))))


def _slot_pages(events: DataFrame, gap: str) -> DataFrame:
    """Different pages per user and slot: the map-side combined input of the URL count."""
    return (
        _user_events(events)
        .where(F.col("page").isNotNull())
        .select("user_id", _slot(gap).alias("slot"), "page")
        .distinct()
    )


def sessions_by_id(events: DataFrame) -> DataFrame:
    """Sessions given by an explicit session id, one per (session_id, user_id)."""
    named = _user_events(events).where(F.col("session_id").isNotNull())
    facts = named.groupBy("session_id", "user_id").agg(
        *_facts(), F.count_distinct("page").alias("unique_urls_count")
    )
    return _derived(facts)


def session_pages(events: DataFrame, gap: str = GAP) -> DataFrame:
    """The ordered page sequence of every session in long form: user_id, session_no, position,
    page, ts, event_id.

    Positions are counted inside a minute of a user and shifted by the session's earlier
    minutes, so a session of any length is spread over its minutes.
    """
    slot_us = gap_micros(gap)
    part_us = MINUTE_US if slot_us % MINUTE_US == 0 else slot_us
    pages = (
        _user_events(events)
        .where(F.col("page").isNotNull())
        .select("user_id", "ts", "event_id", "page", bucket(F.unix_micros("ts"), part_us).alias("part"))
    )
    before = (
        Window.partitionBy("user_id", "session_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        pages.groupBy("user_id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slot", bucket(F.col("part"), slot_us // part_us))
        .join(session_slots(events, gap).select("user_id", "slot", "session_no"), ["user_id", "slot"])
        .select(
            "user_id", "part", "session_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
        )
    )
    local = Window.partitionBy("user_id", "part").orderBy("ts", "event_id")
    return (
        pages.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts, ["user_id", "part"])
        .select(
            "user_id", "session_no", (F.col("_start") + F.col("_local")).alias("position"), "page", "ts", "event_id"
        )
    )


def page_sequences(pages: DataFrame, chunk: int = 10_000, keys: tuple[str, ...] = ("user_id", "session_no")) -> DataFrame:
    """Page sequences as arrays, in order, `chunk` pages per row.

    A session of up to `chunk` pages is one row (chunk_no 0) holding its whole list; a longer
    one continues in further rows, so no row grows with the data.
    """
    numbered = pages.withColumn("chunk_no", bucket(F.col("position"), chunk))
    return (
        numbered.groupBy(*keys, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("position", "page"))).alias("_p"))
        .select(*keys, "chunk_no", F.transform("_p", lambda p: p["page"]).alias("page_view_sequence"))
    )


def stream_sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Sessions by Spark's session window, for streams in append mode.

    All aggregates merge in constant space per session. The exact number of different URLs
    would need every URL of an open session in state; it comes from `sessions` instead.
    `session` is the window, kept for a chained daily aggregate.
    """
    return _derived(
        _user_events(events).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(*_facts())
    )


def daily_session_metrics(finished: DataFrame, gap: str = GAP) -> DataFrame:
    """Per user and day: totals, means, bounce rate, span, different countries.

    A session belongs to the day in which its window ends (last event plus gap); the row is
    labelled with the day its first session started.
    """
    if "session" in finished.columns:
        day = F.window("session", "1 day")
    else:
        window_end = F.timestamp_micros(F.unix_micros("end_time") + gap_micros(gap) - 1)
        day = F.date_trunc("day", window_end)
    n = F.col("total_sessions")
    return (
        finished.groupBy(day.alias("_day"), "user_id")
        .agg(
            F.min("start_time").alias("first_session_time"),
            F.max("end_time").alias("last_session_time"),
            F.count(F.lit(1)).alias("total_sessions"),
            F.sum("duration_seconds").alias("total_duration_seconds"),
            F.sum("page_view_count").alias("total_page_views"),
            F.count_if("is_bounce").alias("bounce_sessions"),
            # At most a day of sessions, each with a small country set.
            F.size(F.array_distinct(F.flatten(F.collect_list("countries")))).alias("unique_countries"),
        )
        .withColumns(
            {
                "date_partition": day_text(F.col("first_session_time")),
                "avg_session_duration": ratio(F.col("total_duration_seconds"), n),
                "avg_page_views_per_session": ratio(F.col("total_page_views"), n),
                "bounce_rate": ratio(F.col("bounce_sessions"), n),
            }
        )
        .drop("_day")
    )


def session_extras(finished: DataFrame) -> DataFrame:
    """Minutes, long-session flag (over 30 minutes) and primary country (smallest code)."""
    return finished.withColumns(
        {
            "duration_minutes": F.col("duration_seconds") / F.lit(60.0),
            "is_long_session": F.col("duration_seconds") > 1800,
            "primary_country": F.get("countries", F.lit(0)),
        }
    )

