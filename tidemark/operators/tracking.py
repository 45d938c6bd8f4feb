"""Running per-user state over stored events: active sessions and page journeys.

The streaming job keeps this state per user (streaming/keyed.py). A backfill over history is
computed here without walking a user's events one by one: events are numbered inside
(user, time bucket) groups, and only one row per bucket is ordered per user to carry the
state across buckets. A user with a third of all events is spread over the user's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.agents import active_device_type
from tidemark.functions.events import get_property, is_page_view
from tidemark.operators.sessions import GAP, gap_micros
from tidemark.sources.offsets import bucket, with_position


def _bucket(width_seconds: int) -> Column:
    return bucket(F.unix_micros("ts"), width_seconds * 1_000_000)


def active_sessions(
    events: DataFrame, timeout: str = GAP, bucket_seconds: int = 900, carried: DataFrame | None = None
) -> DataFrame:
    """One row per event: the user's active session as it stood right after the event.

    `carried` (user_id, session_id, last_activity, event_count, countries) is where the users' sessions
    stood before these events; an event older than that counts as simultaneous with it.

    A run goes on while the session id stays the same and the user is never silent for longer
    than the timeout; otherwise the count starts again at 1. `countries` lists the countries of
    the run so far in order of first sight.
    """
    order = F.struct("ts", "event_id")
    in_bucket = Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id")
    in_run = Window.partitionBy("user_id", "bucket", "run_in_bucket").orderBy("ts", "event_id")
    so_far = (Window.unboundedPreceding, Window.currentRow)

    def goes_on(before: str, after: str) -> Column:
        silence = F.unix_micros(f"{after}.ts") - F.unix_micros(f"{before}.ts")
        same = F.col(f"{before}.session_id").eqNullSafe(F.col(f"{after}.session_id"))
        return F.coalesce(same & (silence <= gap_micros(timeout)), F.lit(False))

    # What is needed of an event is taken before the first shuffle: its properties stay behind.
    events = events.where(F.col("user_id").isNotNull()).select(
        "user_id",
        "ts",
        "event_id",
        "session_id",
        F.when(F.col("country") != "", F.col("country")).alias("country"),
        active_device_type(get_property(F.col("properties"), "user_agent")).alias("device_type"),
    )
    at = F.col("ts")
    if carried is not None:
        events = events.join(carried.select("user_id", F.col("last_activity").alias("_floor")), "user_id", "left")
        at = F.greatest("ts", F.coalesce("_floor", "ts"))

    # Inside a bucket. Run 0 is the one the bucket opens with; whether it began earlier is
    # decided below, from one row per bucket.
    local = (
        events.select(
            "user_id",
            "ts",
            "event_id",
            F.struct(at.alias("ts"), "session_id").alias("here"),
            "country",
            "device_type",
            _bucket(bucket_seconds).alias("bucket"),
        )
        .where(F.col("bucket").isNotNull())
        .withColumn("before", F.lag("here").over(in_bucket))
        .withColumn(
            "run_in_bucket",
            F.sum(F.when(F.col("before").isNull() | goes_on("before", "here"), 0).otherwise(1)).over(
                in_bucket.rowsBetween(*so_far)
            ),
        )
        .withColumn("run_row", F.row_number().over(in_run))
        # Countries are few, so the set and the list of a run stay short however long it is.
        .withColumn("seen", F.collect_set("country").over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(
            "run_countries",
            F.collect_list(F.when(~F.array_contains("seen", F.col("country")), F.col("country"))).over(
                in_run.rowsBetween(*so_far)
            ),
        )
        .drop("seen")
    )

    # Across buckets: the run open at the end of a bucket goes on through every later bucket
    # that holds a single run and links to the bucket before.
    per_user = Window.partitionBy("user_id").orderBy("bucket")
    along = Window.partitionBy("user_id", "chain").orderBy("bucket")
    buckets = (
        local.groupBy("user_id", "bucket")
        .agg(
            F.min_by("here", order).alias("head"),
            # device_type rides along so that both uses of `local` shuffle the same columns and
            # the second one reads the first one's shuffle.
            F.max_by(F.struct("here", "device_type"), order).getField("here").alias("tail"),
            F.max_by("run_in_bucket", order).alias("last_run"),
            F.max_by("run_row", order).alias("tail_rows"),
            F.max_by("run_countries", order).alias("tail_countries"),
        )
    )
    if carried is not None:  # a bucket before all others
        earlier = carried.select(
            "user_id",
            F.lit(-(1 << 62)).alias("bucket"),
            F.struct(F.col("last_activity").alias("ts"), "session_id").alias("tail"),
            F.lit(0).cast("long").alias("last_run"),
            F.col("event_count").alias("tail_rows"),
            F.col("countries").alias("tail_countries"),
        )
        buckets = buckets.unionByName(earlier, allowMissingColumns=True)
    buckets = (
        buckets.withColumn("tail_before", F.lag("tail").over(per_user))
        .withColumn("linked", F.col("tail_before").isNotNull() & goes_on("tail_before", "head"))
        .withColumn("passes", F.col("linked") & (F.col("last_run") == 0))
        .withColumn(
            "chain", F.sum(F.when(F.col("passes"), 0).otherwise(1)).over(per_user.rowsBetween(*so_far))
        )
        .withColumn("countries_before", F.lag("tail_countries").over(along))
        .withColumn(
            "fresh",
            F.when(F.col("countries_before").isNull(), F.col("tail_countries")).otherwise(
                F.array_except("tail_countries", "countries_before")
            ),
        )
        .withColumn("open_rows", F.sum("tail_rows").over(along.rowsBetween(*so_far)))
        .withColumn(
            "open_countries",
            F.array_distinct(
                F.flatten(
                    F.collect_list(F.when(F.size("fresh") > 0, F.col("fresh"))).over(
                        along.rowsBetween(*so_far)
                    )
                )
            ),
        )
        .select(
            "user_id",
            "bucket",
            F.when(F.col("linked"), F.lag("open_rows").over(per_user)).alias("carried_rows"),
            F.when(F.col("linked"), F.lag("open_countries").over(per_user)).alias("carried_countries"),
        )
    )
    inherits = (F.col("run_in_bucket") == 0) & F.col("carried_rows").isNotNull()
    return local.join(buckets, ["user_id", "bucket"]).select(
        "user_id",
        "here.session_id",
        F.col("ts").alias("last_activity"),
        "event_id",
        (F.col("run_row") + F.when(inherits, F.col("carried_rows")).otherwise(F.lit(0))).alias("event_count"),
        F.when(inherits, F.array_distinct(F.concat("carried_countries", "run_countries")))
        .otherwise(F.col("run_countries"))
        .alias("countries"),
        "device_type",
    )


def session_timeouts(events: DataFrame, timeout: str = GAP) -> DataFrame:
    """One timeout record per stretch of activity: the session it ended with and when, one
    timeout after its last event, the user counted as gone."""
    slot = bucket(F.unix_micros("ts"), gap_micros(timeout))
    per_user = Window.partitionBy("user_id").orderBy("slot")
    order = F.struct("ts", "event_id")
    return (
        events.where(F.col("user_id").isNotNull())
        .groupBy("user_id", slot.alias("slot"))
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.max_by("session_id", order).alias("session_id"),
        )
        .withColumn("next_ts", F.lead("first_ts").over(per_user))
        .where(
            F.col("next_ts").isNull()
            | (F.unix_micros("next_ts") - F.unix_micros("last_ts") > gap_micros(timeout))
        )
        .select(
            "user_id",
            "session_id",
            F.col("last_ts").alias("last_activity"),
            F.timestamp_micros(F.unix_micros("last_ts") + gap_micros(timeout)).alias("timeout_at"),
        )
    )


def _journey_views(events: DataFrame) -> DataFrame:
    return events.where(
        F.col("user_id").isNotNull() & is_page_view(F.col("event_type")) & (F.col("url") != "")
    ).select("user_id", "session_id", "url", "ts", "event_id", "country")


def journey_updates(
    events: DataFrame, keep: int = 50, bucket_seconds: int = 900, carried: DataFrame | None = None
) -> DataFrame:
    """One row per page view: its place in the journey, how many pages the journey then keeps
    (the newest `keep`), and when it started.

    `carried` (user_id, session_id, views, started_at) are the journeys before these events.
    """
    views = _journey_views(events)
    key = ["user_id", "session_id"]
    placed = with_position(views, key, [F.col("ts"), F.col("event_id")], _bucket(bucket_seconds), "position")
    started = views.groupBy(*key).agg(F.min("ts").alias("started_at"))
    if carried is not None:
        own, before = started.alias("own"), carried.select(*key, "views", F.col("started_at").alias("first")).alias("before")
        again = (F.col("own.user_id") == F.col("before.user_id")) & F.col("own.session_id").eqNullSafe(F.col("before.session_id"))
        started = own.join(before, again, "left").select(
            *[f"own.{k}" for k in key],
            F.least("own.started_at", F.coalesce("first", "own.started_at")).alias("started_at"),
            F.coalesce("views", F.lit(0)).alias("views"),
        )
    else:
        started = started.withColumn("views", F.lit(0))
    same = placed["user_id"].eqNullSafe(started["user_id"]) & placed["session_id"].eqNullSafe(
        started["session_id"]
    )
    position = F.col("position") + F.col("views")
    return placed.join(started, same).select(
        placed["user_id"],
        placed["session_id"],
        "event_id",
        "url",
        "ts",
        "country",
        position.alias("position"),
        F.least(position + 1, F.lit(keep)).alias("page_count"),
        "started_at",
    )


def latest_journeys(events: DataFrame, keep: int = 50) -> DataFrame:
    """The newest `keep` pages of every journey, oldest first.

    The rank filter works on both sides of the shuffle: a task never sends more than `keep`
    rows of a journey.
    """
    newest = Window.partitionBy("user_id", "session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        _journey_views(events)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= keep)
        .groupBy("user_id", "session_id")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "url", "country"))).alias("p"))
        .select(
            "user_id",
            "session_id",
            F.size("p").alias("page_count"),
            F.transform(
                "p",
                lambda x: F.struct(
                    x["url"].alias("url"), x["ts"].alias("timestamp"), x["country"].alias("country")
                ),
            ).alias("pages"),
        )
    )
