"""Real-time metrics over tumbling windows of typed events (columns as in sources.derive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.events import has_session, has_user, is_error, is_page_view, is_purchase
from tidemark.operators.rollup import (
    Rollup,
    distinct_values,
    keep,
    merge_measures,
    rows,
    split_window,
    tally,
    top_values,
    value_counts,
)

SECOND = "1 second"
MINUTE = "1 minute"


def _window(size: str):
    return F.window("ts", size).alias("w")


def global_metrics(size: str = SECOND) -> Rollup:
    """Events, errors, page views and purchases per window."""
    kind = F.col("event_type")

    def partial(df: DataFrame) -> DataFrame:
        return df.groupBy(_window(size)).agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(is_error(kind)).alias("error_count"),
            F.count_if(is_page_view(kind)).alias("page_view_count"),
            F.count_if(is_purchase(kind)).alias("purchase_count"),
        )

    return Rollup(partial, split_window)


def with_rate_change(metrics: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Percent change of event_count against the window emitted before; 0.0 for the first.

    Windows are compared inside their day, and a day takes over the last count of the day
    before, so no task sees more than a day of windows. On a stream `previous` holds the last
    stored row (window_start, event_count).
    """
    inside = Window.partitionBy("_day").orderBy("window_start")
    day = F.date_trunc("day", "window_start")
    dated = metrics.withColumn("_day", day).where(F.col("_day").isNotNull())
    # The whole row goes into max_by, so that both uses of `dated` keep the same columns and the
    # windows are computed once (the second use reads the first one's shuffle).
    newest = F.max_by(F.struct(*metrics.columns), "window_start").getField("event_count")
    last_of_day = dated.groupBy("_day").agg(newest.alias("_last"))
    if previous is not None:
        seed = previous.select(
            F.lit("0001-01-01").cast("timestamp").alias("_day"), F.col("event_count").alias("_last")
        )
        last_of_day = last_of_day.unionByName(seed)
    carried = last_of_day.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_carried"))
    before = F.coalesce(F.lag("event_count").over(inside), F.col("_carried"))
    change = (F.col("event_count") - F.col("_before")) / F.col("_before") * 100
    return (
        dated.join(carried, "_day")
        .withColumn("_before", before)
        .withColumn("rate_change_percent", F.when(F.col("_before") > 0, change).otherwise(F.lit(0.0)))
        .drop("_day", "_carried", "_before")
    )


def event_type_metrics(size: str = SECOND) -> Rollup:
    """Per event type: events, different users, different countries."""
    measures = {"event_count": rows()}

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            df, [_window(size), "event_type"], measures, {"user": F.col("user_id"), "country": F.col("country")}
        )

    def finish(t: DataFrame) -> DataFrame:
        return split_window(
            t.groupBy("w", "event_type").agg(
                *merge_measures(measures),
                distinct_values("user").alias("unique_users"),
                distinct_values("country").alias("unique_countries"),
            )
        )

    return Rollup(partial, finish)


def country_metrics(size: str = SECOND) -> Rollup:
    """Per country: events, different users, events by type."""
    measures = {"event_count": rows()}

    def partial(df: DataFrame) -> DataFrame:
        return tally(
            keep(df, F.col("country").isNotNull()),
            [_window(size), "country"],
            measures,
            {"type": F.col("event_type"), "user": F.col("user_id")},
        )

    def finish(t: DataFrame) -> DataFrame:
        return split_window(
            t.groupBy("w", "country").agg(
                *merge_measures(measures),
                distinct_values("user").alias("unique_users"),
                value_counts("type").alias("event_type_breakdown"),
            )
        )

    return Rollup(partial, finish)


def active_users(size: str = MINUTE) -> Rollup:
    """Different users and sessions among events that name a user."""

    def partial(df: DataFrame) -> DataFrame:
        session = F.when(has_session(F.col("session_id")), F.col("session_id"))
        return tally(
            keep(df, has_user(F.col("user_id"))),
            [_window(size)],
            {},
            {"user": F.col("user_id"), "session": session},
        )

    def finish(t: DataFrame) -> DataFrame:
        return split_window(
            t.groupBy("w").agg(
                distinct_values("user").alias("active_users"),
                distinct_values("session").alias("active_sessions"),
            )
        )

    return Rollup(partial, finish)


def page_view_metrics(size: str = SECOND, k: int = 10) -> Rollup:
    """Page views with a URL: total, different viewers, the k most viewed URLs."""
    measures = {"total_page_views": rows()}

    def partial(df: DataFrame) -> DataFrame:
        views = keep(df, is_page_view(F.col("event_type")) & F.col("url").isNotNull())
        viewer, url = {"viewer": F.col("user_id")}, {"url": F.when(F.col("url") != "", F.col("url"))}
        if df.isStreaming:
            return tally(views, [_window(size)], measures, viewer | url)
        # On a table each half scans only the columns it needs and no row is multiplied.
        return tally(views, [_window(size)], measures, viewer).unionByName(
            tally(views, [_window(size)], {}, url), allowMissingColumns=True
        )

    def finish(t: DataFrame) -> DataFrame:
        totals = (
            t.where(F.col("dim") == "viewer")
            .groupBy("w")
            .agg(*merge_measures(measures), distinct_values("viewer").alias("unique_viewers"))
        )
        top = top_values(t, ["w"], "url", k, "top_urls")
        none = F.from_json(F.lit("[]"), "array<struct<value:string,n:bigint>>")
        joined = totals.join(top, "w", "left")
        return split_window(joined.withColumn("top_urls", F.coalesce("top_urls", none)))

    return Rollup(partial, finish)


def error_metrics(size: str = SECOND) -> Rollup:
    """Errors: total, different users hit, errors by name."""
    measures = {"error_count": rows()}

    def partial(df: DataFrame) -> DataFrame:
        name = F.coalesce(F.when(F.col("event_name") != "", F.col("event_name")), F.lit("unknown"))
        return tally(
            keep(df, is_error(F.col("event_type"))),
            [_window(size)],
            measures,
            {"name": name, "user": F.col("user_id")},
        )

    def finish(t: DataFrame) -> DataFrame:
        return split_window(
            t.groupBy("w").agg(
                *merge_measures(measures),
                distinct_values("user").alias("affected_users"),
                value_counts("name").alias("error_types"),
            )
        )

    return Rollup(partial, finish)


