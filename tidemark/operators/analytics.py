"""Hourly, daily, cohort, journey, funnel and geographic reports over typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.events import (
    day_text,
    hour_text,
    is_error,
    is_page_view,
    is_product_page,
    is_purchase,
    ratio,
    seconds_between,
)
from tidemark.operators.rollup import (
    Measure,
    Rollup,
    distinct_values,
    keep,
    merge_measures,
    rows,
    rows_where,
    split_window,
    tally,
)
from tidemark.sources.offsets import bucket

HOUR = "1 hour"
DAY = "1 day"


def _window(size: str) -> Column:
    return F.window("ts", size).alias("w")


def hourly_stats(size: str = HOUR) -> Rollup:
    """Per event type and country: events, different users and sessions."""
    measures = {"event_count": rows()}

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            keep(df, F.col("country").isNotNull()),
            [_window(size), "event_type", "country"],
            measures,
            {"user": F.col("user_id"), "session": F.col("session_id")},
        )

    def finish(t: DataFrame) -> DataFrame:
        out = t.groupBy("w", "event_type", "country").agg(
            *merge_measures(measures),
            distinct_values("user").alias("unique_users"),
            distinct_values("session").alias("unique_sessions"),
        )
        return split_window(out).withColumn("hour_window", hour_text(F.col("window_start")))

    return Rollup(partial, finish)


def hourly_page_views(size: str = HOUR, min_count: int = 10) -> Rollup:
    """Page views per URL with at least `min_count` views."""
    measures = {"page_views": rows()}

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            keep(df, is_page_view(F.col("event_type")) & F.col("url").isNotNull()),
            [_window(size), "url"],
            measures,
            {"visitor": F.col("user_id")},
        )

    def finish(t: DataFrame) -> DataFrame:
        out = (
            t.groupBy("w", "url")
            .agg(*merge_measures(measures), distinct_values("visitor").alias("unique_visitors"))
            .where(F.col("page_views") >= min_count)
        )
        return split_window(out).withColumn("hour_window", hour_text(F.col("window_start")))

    return Rollup(partial, finish)


def daily_user_metrics(size: str = DAY) -> Rollup:
    """Per user: totals, different sessions and pages, first and last event."""
    kind = F.col("event_type")
    measures = {
        "total_events": rows(),
        "page_views": rows_where(is_page_view(kind)),
        "purchases": rows_where(is_purchase(kind)),
        "first_event_time": Measure(F.col("ts"), "min"),
        "last_event_time": Measure(F.col("ts"), "max"),
    }

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            keep(df, F.col("user_id").isNotNull()),
            [_window(size), "user_id"],
            measures,
            {"session": F.col("session_id"), "page": F.col("url")},
        )

    def finish(t: DataFrame) -> DataFrame:
        out = t.groupBy("w", "user_id").agg(
            *merge_measures(measures),
            distinct_values("session").alias("sessions"),
            distinct_values("page").alias("unique_pages_visited"),
        )
        return split_window(out).withColumn("date_partition", day_text(F.col("window_start")))

    return Rollup(partial, finish)


def daily_cohorts(size: str = DAY, frame_rows: int = 7) -> Rollup:
    """Per country and event type: users, events, and the mean over the last `frame_rows` rows
    (rows, not calendar days)."""
    measures = {"total_events": rows()}

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            keep(df, F.col("country").isNotNull() & F.col("event_type").isNotNull()),
            [_window(size), "country", "event_type"],
            measures,
            {"user": F.col("user_id")},
        )

    def finish(t: DataFrame) -> DataFrame:
        out = t.groupBy("w", "country", "event_type").agg(
            *merge_measures(measures), distinct_values("user").alias("unique_users")
        )
        return with_trailing_average(
            split_window(out).withColumn("date_partition", day_text(F.col("window_start"))), frame_rows
        )

    def remember(rows: DataFrame) -> DataFrame:
        newest = Window.partitionBy("country", "event_type").orderBy(F.desc("window_start"))
        return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") < frame_rows).drop("_r")

    def carry(new: DataFrame, earlier: DataFrame) -> DataFrame:
        both = new.withColumn("_new", F.lit(True)).unionByName(earlier.withColumn("_new", F.lit(False)))
        return with_trailing_average(both, frame_rows).where("_new").select(new.columns)

    return Rollup(partial, finish, carry, remember)


def with_trailing_average(daily: DataFrame, frame_rows: int = 7) -> DataFrame:
    """One row per day and cohort comes in, so a group is as long as the calendar."""
    frame = (
        Window.partitionBy("country", "event_type")
        .orderBy("window_start")
        .rowsBetween(-(frame_rows - 1), Window.currentRow)
    )
    return daily.withColumn("seven_day_avg_events", F.avg("total_events").over(frame))


def event_order() -> Column:
    """Event time, ties by id: the order used wherever 'first' and 'last' matter."""
    return F.struct("ts", "event_id")


def user_journeys(min_events: int = 2) -> Rollup:
    """Per session and user: size, span, first and last URL, bounce flag."""
    with_url = F.when(F.col("url").isNotNull(), event_order())

    def aggregate(df: DataFrame, keys: list[Column | str]) -> DataFrame:
        return keep(df, F.col("session_id").isNotNull()).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("events_in_session"),
            F.count_if(is_page_view(F.col("event_type"))).alias("page_views"),
            F.min("ts").alias("session_start"),
            F.max("ts").alias("session_end"),
            F.min_by("url", with_url).alias("landing_page"),
            F.max_by("url", with_url).alias("exit_page"),
        )

    def partial(df: DataFrame) -> DataFrame:
        # A stream needs a window to know when a session is over: a day without a row of it.
        keys = [F.session_window("ts", DAY).alias("w")] if df.isStreaming else []
        return aggregate(df, [*keys, "session_id", "user_id"]).drop("w")

    def finish(t: DataFrame) -> DataFrame:
        return t.where(F.col("events_in_session") >= min_events).withColumns(
            {
                "session_duration_seconds": seconds_between(F.col("session_start"), F.col("session_end")),
                "is_bounce": F.col("page_views") <= 1,
            }
        )

    return Rollup(partial, finish)


def session_edge_pages(events: DataFrame) -> DataFrame:
    """First and last non-null URL of each session.

    A frame over the whole session would sort a long session in one task; min_by / max_by give
    the same two values and combine map-side.
    """
    with_url = F.when(F.col("url").isNotNull(), event_order())
    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.min_by("url", with_url).alias("landing_page"), F.max_by("url", with_url).alias("exit_page"))
    )


_STEPS = ("viewed_product", "added_to_cart", "started_checkout", "completed_purchase")


def conversion_funnel() -> Rollup:
    """Per day: users who reached each step (in any order) and three step-to-step rates."""
    kind = F.col("event_type")
    flags = {
        "viewed_product": is_page_view(kind) & is_product_page(F.col("url")),
        "added_to_cart": kind == "add_to_cart",
        "started_checkout": kind == "checkout",
        "completed_purchase": is_purchase(kind),
    }

    def partial(df: DataFrame) -> DataFrame:
        return (
            keep(df, F.col("user_id").isNotNull())
            .groupBy(_window(DAY), "user_id")
            .agg(*[F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in flags.items()])
        )

    def finish(t: DataFrame) -> DataFrame:
        sums = t.groupBy(day_text(F.col("w.start")).alias("date_partition")).agg(
            F.count(F.lit(1)).alias("total_users"),
            *[F.sum(s).alias(f"users_{s}") for s in _STEPS],
        )
        view, cart, checkout, bought = (F.col(f"users_{s}") for s in _STEPS)
        return sums.withColumns(
            {
                "product_to_cart_rate": ratio(cart, view),
                "cart_to_checkout_rate": ratio(checkout, cart),
                "checkout_to_purchase_rate": ratio(bought, checkout),
            }
        )

    return Rollup(partial, finish)


def minute_counters(per_user: bool = False, size: str = "1 minute") -> Rollup:
    """Events per minute, overall or per user (user 0 and no user do not count as one)."""

    def partial(df: DataFrame) -> DataFrame:
        if not per_user:
            return df.groupBy(_window(size)).agg(F.count(F.lit(1)).alias("events_count"))
        named = keep(df, F.col("user_id").isNotNull() & (F.col("user_id") != 0))
        return named.groupBy(_window(size), "user_id").agg(F.count(F.lit(1)).alias("events_count"))

    return Rollup(partial, split_window)


def realtime_metrics(counters: DataFrame, as_of: Column, time_window: str = "1m") -> DataFrame:
    """The count of the minute `as_of` lies in; 0 when nothing happened. Only '1m' is known."""
    now = counters.where(F.col("window_start") == F.date_trunc("minute", as_of))
    found = now.agg(F.coalesce(F.sum("events_count"), F.lit(0)).alias("events_count"))
    out = found.select(F.lit(time_window).alias("time_window"), "events_count", as_of.alias("timestamp"))
    return out if time_window == "1m" else out.where(F.lit(False))


def geo_panes(df: DataFrame, slide: str = HOUR) -> DataFrame:
    """One row per slide, country, city and user: the input of geo_windows, on table and stream."""
    kind = F.col("event_type")
    return (
        keep(df, F.col("country").isNotNull())
        .groupBy(_window(slide), "country", "city", "user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(is_purchase(kind)).alias("purchases"),
            F.count_if(is_error(kind)).alias("errors"),
        )
        .select(F.col("w.start").alias("pane"), "country", "city", "user_id", "events", "purchases", "errors")
    )


def geo_windows(
    panes: DataFrame, slide_seconds: int = 3600, slides: int = 24, min_count: int = 100
) -> DataFrame:
    """Sliding windows of `slides` panes per country and city.

    Nothing is copied into 24 windows. A pane raises the sums from the first window that holds it
    and lowers them after the last; a user raises the number of users only from the first window
    the user's previous pane did not reach. One running sum per place over these steps gives every
    window; steps are at most three per pane and are added up by place and hour before the shuffle.
    """
    place = ["country", "city"]
    per_user = Window.partitionBy(*place, "user_id").orderBy("_p")
    sums = ["events", "purchases", "errors"]
    # Pane p lies in the windows starting at p-slides+1 .. p; the previous pane q reached up to q.
    first = F.col("_p") - (slides - 1)
    known = F.col("user_id").isNotNull().cast("long")

    def step(at: Column, sign: int, users: Column) -> Column:
        return F.struct(
            at.alias("_start"), *[(F.col(c) * sign).cast("long").alias(c) for c in sums], users.alias("users")
        )

    nothing = F.struct(
        F.greatest(first, F.coalesce(F.col("_known") + 1, first)).alias("_start"),
        *[F.lit(0).cast("long").alias(c) for c in sums],
        known.alias("users"),
    )
    steps = F.array(step(first, 1, F.lit(0).cast("long")), step(F.col("_p") + 1, -1, -known), nothing)
    numbered = panes.withColumn("_p", bucket(F.unix_seconds("pane"), slide_seconds))
    changes = (
        numbered.withColumn("_known", F.lag("_p").over(per_user))
        .select(*place, F.inline(steps))
        .groupBy(*place, "_start")
        .agg(*[F.sum(c).alias(c) for c in (*sums, "users")])
    )
    along = Window.partitionBy(*place).orderBy("_start")
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = changes.select(
        *place,
        "_start",
        F.lead("_start").over(along).alias("_next"),
        F.sum("events").over(run).alias("total_events"),
        F.sum("users").over(run).alias("unique_users"),
        F.sum("purchases").over(run).alias("_purchases"),
        F.sum("errors").over(run).alias("error_count"),
    )
    return (
        totals.where((F.col("total_events") > 0) & F.col("_next").isNotNull())
        .withColumn("_start", F.explode(F.sequence(F.col("_start"), F.col("_next") - 1)))
        .where(F.col("total_events") >= min_count)
        .select(
            F.timestamp_seconds(F.col("_start") * slide_seconds).alias("window_start"),
            F.timestamp_seconds((F.col("_start") + slides) * slide_seconds).alias("window_end"),
            *place,
            "total_events",
            "unique_users",
            ratio(F.col("_purchases"), F.col("total_events")).alias("purchase_rate"),
            "error_count",
            ratio(F.col("error_count"), F.col("total_events")).alias("error_rate"),
        )
    )


def geo_analysis(df: DataFrame, min_count: int = 100) -> DataFrame:
    """24 hours by 1 hour, as the two steps above."""
    return geo_windows(geo_panes(df), min_count=min_count)


def geo_analysis_stream(df: DataFrame, size: str = "24 hours", slide: str = HOUR) -> DataFrame:
    """The plain sliding-window form: event and error counts, usable on a stream."""
    kind = F.col("event_type")
    return split_window(
        keep(df, F.col("country").isNotNull())
        .groupBy(F.window("ts", size, slide).alias("w"), "country", "city")
        .agg(F.count(F.lit(1)).alias("total_events"), F.count_if(is_error(kind)).alias("error_count"))
    )
