"""Click-stream queries: event expressions, metrics, analytics, sessions, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import agents, events as ev
from tidemark.operators import adhoc, analytics, metrics, sessions, tracking
from tidemark.plans.registry import clicks, clicks_sql, micros, pairs, query, text, visits
from tidemark.sources.derive import COUNTRY_CODES, clickstream
from tidemark.sources.tables import table
from tidemark.sources.wire import decode_events

# ---------------------------------------------------------------- event expressions


@query(
    "exp6_event_defaults",
    clicks_sql(
        """SELECT event_id, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE event_type END AS event_type,
        epoch_us(CASE WHEN k % 11 IN (0, 1) THEN TIMESTAMP '2024-06-01 00:00:00' ELSE date_trunc('second', ts) END)
          AS ts_us,
        strftime(CASE WHEN k % 11 IN (0, 1) THEN TIMESTAMP '2024-06-01 00:00:00' ELSE ts END, '%Y-%m-%d')
          AS date_partition FROM clicks"""
    ),
)
def exp6(spark: SparkSession, root: str) -> DataFrame:
    """Wire text with holes: no type, no time, unreadable time, a trailing Z."""
    k = F.get_json_object("properties", "$.k").cast("int")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    written = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.lit("yesterday")).otherwise(iso)
    lines = clicks(spark, root).select(
        F.to_json(
            F.struct(
                "event_id",
                "user_id",
                F.when(k % 7 != 0, F.col("event_type")).alias("event_type"),
                written.alias("timestamp"),
            )
        ).alias("value")
    )
    received = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return ev.with_defaults(decode_events(lines), received).select(
        "event_id", "event_type", micros("ts").alias("ts_us"), "date_partition"
    )


@query(
    "exp7_exp8_exp9_exp10_event_fields",
    clicks_sql(
        """SELECT event_id, epoch_us(ts) // 1000 AS event_time_ms,
        CASE WHEN user_id <> 0 THEN CAST(user_id AS VARCHAR) ELSE event_id END AS event_key,
        user_id IS NOT NULL AS has_user, k % 4 <> 0 AS has_session,
        event_type = 'page_view' AS is_page_view, event_type = 'purchase' AS is_purchase,
        event_type = 'error' AS is_error FROM clicks"""
    ),
)
def exp7(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("properties", "$.k").cast("int")
    kind = F.col("event_type")
    sid = F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 4, F.lit("  ")).otherwise(F.col("session_id"))
    return clicks(spark, root).select(
        "event_id",
        ev.event_time_millis(F.col("ts")).alias("event_time_ms"),
        ev.event_key(F.col("user_id"), F.col("event_id")).alias("event_key"),
        ev.has_user(F.col("user_id")).alias("has_user"),
        ev.has_session(sid).alias("has_session"),
        ev.is_page_view(kind).alias("is_page_view"),
        ev.is_purchase(kind).alias("is_purchase"),
        ev.is_error(kind).alias("is_error"),
    )


@query(
    "exp11_property_amount",
    clicks_sql(
        """SELECT event_id, coalesce(user_agent, 'none') AS agent,
        CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS amount FROM clicks"""
    ),
)
def exp11(spark: SparkSession, root: str) -> DataFrame:
    props = F.col("properties")
    return clicks(spark, root).select(
        "event_id",
        ev.get_property(props, "user_agent", "none").alias("agent"),
        ev.purchase_amount(F.col("event_type"), props, "k").alias("amount"),
    )


@query(
    "exp12_event_copies",
    clicks_sql(
        """SELECT event_id, concat('s', CAST(user_id AS VARCHAR)) AS session_id,
        epoch_us(ts + INTERVAL 12 HOUR) AS ts_us, strftime(ts + INTERVAL 12 HOUR, '%Y-%m-%d') AS date_partition
        FROM clicks"""
    ),
)
def exp12(spark: SparkSession, root: str) -> DataFrame:
    moved = ev.with_timestamp(clicks(spark, root), F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    renamed = ev.with_session_id(moved, F.concat(F.lit("s"), F.col("user_id").cast("string")))
    return renamed.select("event_id", "session_id", micros("ts").alias("ts_us"), "date_partition")


@query(
    "exp13_event_json",
    clicks_sql(
        """SELECT concat('{"event_id":"', event_id, '","user_id":', CAST(user_id AS VARCHAR), ',"session_id":"', session_id,
        '","event_type":"', event_type, '","event_name":', CASE WHEN event_name IS NULL THEN 'null'
          ELSE concat('"', event_name, '"') END, ',"properties":{"k":"', CAST(k AS VARCHAR), '"',
        CASE WHEN user_agent IS NULL THEN '' ELSE concat(',"user_agent":"', user_agent, '"') END,
        '},"url":"', url, '","country":',
        CASE WHEN country IS NULL THEN 'null' ELSE concat('"', country, '"') END, ',"city":',
        CASE WHEN city IS NULL THEN 'null' ELSE concat('"', city, '"') END, ',"timestamp":"',
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '","date_partition":"', date_partition, '"}') AS value FROM clicks"""
    ),
)
def exp13(spark: SparkSession, root: str) -> DataFrame:
    return clicks(spark, root).select(ev.event_json().alias("value"))


_DEVICE = """CASE WHEN user_agent IS NULL THEN NULL
  WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'mobile'
  WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'tablet' ELSE 'desktop' END"""
_BROWSER = """CASE WHEN user_agent IS NULL THEN NULL WHEN lower(user_agent) LIKE '%chrome%' THEN 'chrome'
  WHEN lower(user_agent) LIKE '%firefox%' THEN 'firefox' WHEN lower(user_agent) LIKE '%safari%' THEN 'safari'
  WHEN lower(user_agent) LIKE '%edge%' THEN 'edge' ELSE 'other' END"""


@query(
    "exp14_exp15_exp16_user_agents",
    clicks_sql(
        f"""SELECT {_DEVICE} AS device_type, {_BROWSER} AS browser, coalesce({_DEVICE}, 'desktop') AS active_device,
        count(*) AS events FROM clicks GROUP BY ALL"""
    ),
)
def exp14(spark: SparkSession, root: str) -> DataFrame:
    ua = ev.get_property(F.col("properties"), "user_agent")
    return (
        clicks(spark, root)
        .groupBy(
            agents.device_type(ua).alias("device_type"),
            agents.browser(ua).alias("browser"),
            agents.active_device_type(ua).alias("active_device"),
        )
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "exp17_exp19_exp21_buckets",
    clicks_sql(
        """SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour_window, strftime(ts, '%Y-%m-%d') AS day,
        count(*) AS events, count(*) FILTER (url LIKE '%/product/%') AS product_pages FROM clicks
        WHERE country IS NOT NULL AND url IS NOT NULL GROUP BY ALL"""
    ),
)
def exp17(spark: SparkSession, root: str) -> DataFrame:
    kept = clicks(spark, root).where(F.col("country").isNotNull() & F.col("url").isNotNull())
    return kept.groupBy(
        ev.hour_text(F.col("ts")).alias("hour_window"), ev.day_text(F.col("ts")).alias("day")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(ev.is_product_page(F.col("url"))).alias("product_pages"),
    )


@query(
    "exp18_exp20_ratio_and_span",
    clicks_sql(
        """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'page_view') > 0
          THEN CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / count(*) FILTER (event_type = 'page_view')
          ELSE CAST(0 AS DOUBLE) END AS purchases_per_view,
        CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS span_seconds,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS span_exact FROM clicks GROUP BY user_id"""
    ),
)
def exp18(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    per_user = clicks(spark, root).groupBy("user_id").agg(
        F.count_if(ev.is_purchase(kind)).alias("p"),
        F.count_if(ev.is_page_view(kind)).alias("v"),
        F.min("ts").alias("a"),
        F.max("ts").alias("b"),
    )
    return per_user.select(
        "user_id",
        ev.ratio(F.col("p"), F.col("v")).alias("purchases_per_view"),
        ev.whole_seconds_between(F.col("a"), F.col("b")).alias("span_seconds"),
        ev.seconds_between(F.col("a"), F.col("b")).alias("span_exact"),
    )


# ---------------------------------------------------------------- real-time metrics
# The raw events are about 14 per hour at the smallest scale, so each metric also runs by the hour.

_UNIT = {"1s": ("1 second", "second"), "1m": ("1 minute", "minute"), "1h": ("1 hour", "hour")}


def _bounds(unit: str) -> str:
    """DuckDB text of the tumbling window an event lies in."""
    start = f"date_trunc('{unit}', ts)"
    form = "'%Y-%m-%d %H:%M:%S'"
    return (
        f"strftime({start}, {form}) AS window_start, "
        f"strftime({start} + INTERVAL 1 {unit}, {form}) AS window_end"
    )


def _texted(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": text("window_start"), "window_end": text("window_end")})


def _global_sql(unit: str) -> str:
    return clicks_sql(
        """SELECT * EXCLUDE (p), CASE WHEN p > 0 THEN (event_count - p) / CAST(p AS DOUBLE) * 100
          ELSE CAST(0 AS DOUBLE) END AS rate_change_percent
        FROM (SELECT *, lag(event_count) OVER (ORDER BY window_start) AS p FROM g)""",
        f"""g AS (SELECT {_bounds(unit)}, count(*) AS event_count, count(*) FILTER (event_type = 'error') AS error_count,
        count(*) FILTER (event_type = 'page_view') AS page_view_count,
        count(*) FILTER (event_type = 'purchase') AS purchase_count FROM clicks GROUP BY ALL)""",
    )


def _type_sql(unit: str) -> str:
    return clicks_sql(
        f"""SELECT {_bounds(unit)}, event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
        count(DISTINCT country) AS unique_countries FROM clicks GROUP BY ALL"""
    )


def _country_sql(unit: str) -> str:
    return clicks_sql(
        """SELECT window_start, window_end, country, any_value(c) AS event_count, any_value(u) AS unique_users,
        string_agg(concat(event_type, ':', CAST(n AS VARCHAR)), ',' ORDER BY event_type) AS event_type_breakdown
        FROM t JOIN g USING (window_start, window_end, country) GROUP BY window_start, window_end, country""",
        f"""t AS (SELECT {_bounds(unit)}, country, event_type, count(*) AS n FROM clicks
          WHERE country IS NOT NULL GROUP BY ALL)""",
        f"""g AS (SELECT {_bounds(unit)}, country, count(*) AS c, count(DISTINCT user_id) AS u FROM clicks
          WHERE country IS NOT NULL GROUP BY ALL)""",
    )


def _active_sql(unit: str) -> str:
    return clicks_sql(
        f"""SELECT {_bounds(unit)}, count(DISTINCT user_id) AS active_users,
        count(DISTINCT session_id) AS active_sessions FROM clicks WHERE user_id IS NOT NULL GROUP BY ALL"""
    )


def _views_sql(unit: str) -> str:
    return clicks_sql(
        """SELECT window_start, window_end, any_value(c) AS total_page_views, any_value(u) AS unique_viewers,
        string_agg(concat(url, ':', CAST(n AS VARCHAR)), ',' ORDER BY n DESC, url) AS top_urls
        FROM r JOIN g USING (window_start, window_end) WHERE rank <= 10 GROUP BY window_start, window_end""",
        "v AS (SELECT * FROM clicks WHERE event_type = 'page_view' AND url IS NOT NULL)",
        f"""n AS (SELECT {_bounds(unit)}, url, count(*) AS n FROM v GROUP BY ALL)""",
        "r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, url) AS rank FROM n)",
        f"g AS (SELECT {_bounds(unit)}, count(*) AS c, count(DISTINCT user_id) AS u FROM v GROUP BY ALL)",
    )


def _error_sql(unit: str) -> str:
    return clicks_sql(
        """SELECT window_start, window_end, any_value(c) AS error_count, any_value(u) AS affected_users,
        string_agg(concat(name, ':', CAST(n AS VARCHAR)), ',' ORDER BY name) AS error_types
        FROM n JOIN g USING (window_start, window_end) GROUP BY window_start, window_end""",
        "e AS (SELECT *, coalesce(event_name, 'unknown') AS name FROM clicks WHERE event_type = 'error')",
        f"n AS (SELECT {_bounds(unit)}, name, count(*) AS n FROM e GROUP BY ALL)",
        f"g AS (SELECT {_bounds(unit)}, count(*) AS c, count(DISTINCT user_id) AS u FROM e GROUP BY ALL)",
    )


def _run_global(df: DataFrame, size: str) -> DataFrame:
    return metrics.with_rate_change(metrics.global_metrics(size)(df))


def _run_views(df: DataFrame, size: str) -> DataFrame:
    listed = F.transform("top_urls", lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string")))
    return metrics.page_view_metrics(size)(df).withColumn("top_urls", F.array_join(listed, ","))


def _run_country(df: DataFrame, size: str) -> DataFrame:
    out = metrics.country_metrics(size)(df)
    return out.withColumn("event_type_breakdown", pairs("event_type_breakdown"))


def _run_errors(df: DataFrame, size: str) -> DataFrame:
    return metrics.error_metrics(size)(df).withColumn("error_types", pairs("error_types"))


_METRICS = {
    "agg12_win4_global_metrics": (_global_sql, _run_global, ("1s", "1h"), visits),
    "agg13_event_type_metrics": (_type_sql, lambda d, s: metrics.event_type_metrics(s)(d), ("1s", "1h"), visits),
    "agg14_country_metrics": (_country_sql, _run_country, ("1s", "1h"), visits),
    "agg15_active_users": (_active_sql, lambda d, s: metrics.active_users(s)(d), ("1m", "1h"), visits),
    "agg16_top1_page_views": (_views_sql, _run_views, ("1s", "1h"), clicks),
    "agg17_error_metrics": (_error_sql, _run_errors, ("1s", "1h"), clicks),
}


def _register_metrics() -> None:
    for name, (sql, run, sizes, read) in _METRICS.items():
        for size in sizes:
            spark_size, unit = _UNIT[size]
            query(f"{name}_{size}", sql(unit))(
                lambda spark, root, run=run, read=read, s=spark_size: _texted(run(read(spark, root), s))
            )


_register_metrics()

# ---------------------------------------------------------------- analytics


@query(
    "agg18_hourly_stats",
    clicks_sql(
        """SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour_window,
        strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, country,
        count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
        count(DISTINCT session_id) AS unique_sessions FROM clicks WHERE country IS NOT NULL GROUP BY ALL"""
    ),
)
def agg18(spark: SparkSession, root: str) -> DataFrame:
    out = analytics.hourly_stats()(visits(spark, root))
    return out.withColumn("window_end", text("window_end")).drop("window_start")


def _hourly_pages(name: str, min_count: int) -> None:
    @query(
        name,
        clicks_sql(
            f"""SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour_window,
            strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, url,
            count(*) AS page_views, count(DISTINCT user_id) AS unique_visitors FROM clicks
            WHERE event_type = 'page_view' AND url IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_count}"""
        ),
    )
    def run(spark: SparkSession, root: str) -> DataFrame:
        out = analytics.hourly_page_views(min_count=min_count)(clicks(spark, root))
        return out.withColumn("window_end", text("window_end")).drop("window_start")


_hourly_pages("agg19_hourly_page_views", 10)
_hourly_pages("agg19_hourly_page_views_min1", 1)


@query(
    "agg20_daily_user_metrics",
    clicks_sql(
        """SELECT strftime(ts, '%Y-%m-%d') AS date_partition, user_id, count(*) AS total_events,
        count(*) FILTER (event_type = 'page_view') AS page_views,
        count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT session_id) AS sessions,
        count(DISTINCT url) AS unique_pages_visited, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
        FROM clicks WHERE user_id IS NOT NULL GROUP BY ALL"""
    ),
)
def agg20(spark: SparkSession, root: str) -> DataFrame:
    out = analytics.daily_user_metrics()(clicks(spark, root))
    return out.withColumns(
        {"first_us": micros("first_event_time"), "last_us": micros("last_event_time")}
    ).drop("window_start", "window_end", "first_event_time", "last_event_time")


@query(
    "agg21_win1_daily_cohorts",
    clicks_sql(
        """SELECT date_partition, country, event_type, total_events, unique_users,
        avg(total_events) OVER (PARTITION BY country, event_type ORDER BY date_partition
          ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS seven_day_avg_events
        FROM (SELECT date_partition, country, event_type, count(*) AS total_events,
          count(DISTINCT user_id) AS unique_users FROM clicks WHERE country IS NOT NULL GROUP BY ALL)"""
    ),
)
def agg21(spark: SparkSession, root: str) -> DataFrame:
    return analytics.daily_cohorts()(visits(spark, root)).drop("window_start", "window_end")


@query(
    "agg22_user_journeys",
    clicks_sql(
        """SELECT session_id, user_id, count(*) AS events_in_session,
        count(*) FILTER (event_type = 'page_view') AS page_views, epoch_us(min(ts)) AS start_us,
        epoch_us(max(ts)) AS end_us,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS session_duration_seconds,
        first(url ORDER BY ts, event_id) AS landing_page, last(url ORDER BY ts, event_id) AS exit_page,
        count(*) FILTER (event_type = 'page_view') <= 1 AS is_bounce FROM clicks
        WHERE session_id IS NOT NULL GROUP BY session_id, user_id HAVING count(*) >= 2"""
    ),
)
def agg22(spark: SparkSession, root: str) -> DataFrame:
    out = analytics.user_journeys()(clicks(spark, root))
    return out.withColumns({"start_us": micros("session_start"), "end_us": micros("session_end")}).drop(
        "session_start", "session_end"
    )


@query(
    "win2_win3_session_edge_pages",
    clicks_sql(
        """SELECT DISTINCT session_id, first_value(u IGNORE NULLS) OVER w AS landing_page,
        last_value(u IGNORE NULLS) OVER w AS exit_page
        FROM (SELECT *, CASE WHEN event_type = 'page_view' THEN url END AS u FROM clicks)
        WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    ),
)
def win2(spark: SparkSession, root: str) -> DataFrame:
    viewed = clicks(spark, root).withColumn("url", F.when(ev.is_page_view(F.col("event_type")), F.col("url")))
    return analytics.session_edge_pages(viewed)


@query(
    "agg23_conversion_funnel",
    clicks_sql(
        """SELECT date_partition, count(*) AS total_users, CAST(sum(v) AS BIGINT) AS users_viewed_product,
        CAST(sum(a) AS BIGINT) AS users_added_to_cart, CAST(sum(c) AS BIGINT) AS users_started_checkout,
        CAST(sum(p) AS BIGINT) AS users_completed_purchase,
        CASE WHEN sum(v) > 0 THEN CAST(sum(a) AS DOUBLE) / CAST(sum(v) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
          AS product_to_cart_rate,
        CASE WHEN sum(a) > 0 THEN CAST(sum(c) AS DOUBLE) / CAST(sum(a) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
          AS cart_to_checkout_rate,
        CASE WHEN sum(c) > 0 THEN CAST(sum(p) AS DOUBLE) / CAST(sum(c) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
          AS checkout_to_purchase_rate
        FROM f GROUP BY date_partition""",
        """f AS (SELECT user_id, date_partition,
          max(CASE WHEN event_type = 'page_view' AND url LIKE '%/product/%' THEN 1 ELSE 0 END) v,
          max(CASE WHEN event_type = 'add_to_cart' THEN 1 ELSE 0 END) a,
          max(CASE WHEN event_type = 'checkout' THEN 1 ELSE 0 END) c,
          max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) p
          FROM clicks WHERE user_id IS NOT NULL GROUP BY ALL)""",
    ),
)
def agg23(spark: SparkSession, root: str) -> DataFrame:
    return analytics.conversion_funnel()(clicks(spark, root))


@query(
    "agg24_minute_counters",
    clicks_sql(
        """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events_count
        FROM clicks GROUP BY ALL"""
    ),
)
def agg24(spark: SparkSession, root: str) -> DataFrame:
    out = analytics.minute_counters()(visits(spark, root))
    return out.withColumn("window_start", text("window_start")).drop("window_end")


@query(
    "agg24_minute_counters_per_user",
    clicks_sql(
        """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id,
        count(*) AS events_count FROM clicks WHERE user_id <> 0 GROUP BY ALL"""
    ),
)
def agg24_user(spark: SparkSession, root: str) -> DataFrame:
    out = analytics.minute_counters(per_user=True)(visits(spark, root))
    return out.withColumn("window_start", text("window_start")).drop("window_end")


@query(
    "agg25_realtime_metrics",
    clicks_sql(
        """SELECT '1m' AS time_window, '2024-01-10 12:34:56' AS timestamp, count(*) AS events_count FROM clicks
        WHERE date_trunc('minute', ts) = TIMESTAMP '2024-01-10 12:34:00'"""
    ),
)
def agg25(spark: SparkSession, root: str) -> DataFrame:
    as_of = F.lit("2024-01-10 12:34:56").cast("timestamp")
    # The minute bounds the scan: nothing else is read or counted.
    first, last = (F.lit(f"2024-01-10 12:{m}:00").cast("timestamp_ntz") for m in (34, 35))
    minute = table(spark, root, "events").where((F.col("ts") >= first) & (F.col("ts") < last))
    counters = analytics.minute_counters()(clickstream(minute, pages=False))
    return analytics.realtime_metrics(counters, as_of).withColumn("timestamp", text("timestamp"))


def _geo(name: str, min_count: int) -> None:
    @query(
        name,
        clicks_sql(
            f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
            strftime(s + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, country, city,
            count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
            avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS purchase_rate,
            count(*) FILTER (event_type = 'error') AS error_count,
            CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate
            FROM (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS s
              FROM clicks, (SELECT unnest(range(24)) AS h) WHERE country IS NOT NULL)
            GROUP BY s, country, city HAVING count(*) >= {min_count}"""
        ),
    )
    def run(spark: SparkSession, root: str) -> DataFrame:
        return _texted(analytics.geo_analysis(visits(spark, root), min_count))


_geo("agg26_geo_analysis", 100)
_geo("agg26_geo_analysis_min2", 2)


@query(
    "qry1_adhoc_sql",
    clicks_sql(
        """SELECT country, count(*) AS events, sum(value) > 0 AS any_value FROM clicks
        WHERE event_type = 'purchase' AND user_id >= 10 GROUP BY country"""
    ),
)
def qry1(spark: SparkSession, root: str) -> DataFrame:
    return adhoc.query(
        spark,
        """SELECT country, count(*) AS events, sum(value) > 0 AS any_value FROM {warm}
        WHERE event_type = :kind AND user_id >= :first GROUP BY country""",
        {"kind": "purchase", "first": 10},
        warm=clicks(spark, root),
    )


# ---------------------------------------------------------------- sessions


def _session_ctes(gap_minutes: int) -> tuple[str, ...]:
    gap = gap_minutes * 60 * 1_000_000
    return (
        f"""m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER o) > {gap} THEN 1 ELSE 0 END AS brk
          FROM clicks WHERE user_id IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))""",
        """n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no,
          CASE WHEN event_type = 'page_view' THEN url END AS page FROM m)""",
        f"""s AS (SELECT user_id, session_no, first(session_id ORDER BY ts, event_id) AS session_id,
          min(ts) AS a, max(ts) AS b, count(*) AS event_count,
          count(*) FILTER (event_type = 'page_view') AS page_view_count, count(DISTINCT page) AS unique_urls_count,
          coalesce(array_to_string(list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)), ','), '')
            AS countries,
          first(page ORDER BY ts, event_id) FILTER (page IS NOT NULL) AS landing_page,
          last(page ORDER BY ts, event_id) FILTER (page IS NOT NULL) AS exit_page,
          first(user_agent ORDER BY ts, event_id) FILTER (user_agent IS NOT NULL) AS user_agent
          FROM n GROUP BY user_id, session_no)""",
        f"""z AS (SELECT session_id, user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us,
          CAST((epoch_us(b) - epoch_us(a)) // 1000000 AS BIGINT) AS duration_seconds, event_count, page_view_count,
          unique_urls_count, countries, landing_page, exit_page, page_view_count <= 1 AS is_bounce,
          {_DEVICE} AS device_type, {_BROWSER} AS browser, strftime(a, '%Y-%m-%d') AS date_partition FROM s)""",
    )


def flat_sessions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "start_us": micros("start_time"),
            "end_us": micros("end_time"),
            "countries": F.array_join("countries", ","),
        }
    ).drop("start_time", "end_time")


def _sessions(name: str, minutes: int) -> None:
    @query(name, clicks_sql("SELECT * FROM z", *_session_ctes(minutes)))
    def run(spark: SparkSession, root: str) -> DataFrame:
        return flat_sessions(sessions.sessions(clicks(spark, root), f"{minutes} minutes"))


_sessions("agg27_sessions_30m", 30)
_sessions("agg27_sessions_6h", 360)


@query(
    "str6_top2_session_pages_6h",
    clicks_sql(
        """SELECT user_id, session_no, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) - 1
          AS position, page, epoch_us(ts) AS ts_us, event_id FROM n WHERE page IS NOT NULL""",
        *_session_ctes(360),
    ),
)
def str6(spark: SparkSession, root: str) -> DataFrame:
    pages = sessions.session_pages(clicks(spark, root), "6 hours")
    return pages.withColumn("ts_us", micros("ts")).drop("ts")


@query(
    "str6_page_sequences_6h",
    clicks_sql(
        """SELECT user_id, session_no, CAST(0 AS BIGINT) AS chunk_no,
        string_agg(page, ' ' ORDER BY ts, event_id) AS page_view_sequence FROM n WHERE page IS NOT NULL
        GROUP BY user_id, session_no""",
        *_session_ctes(360),
    ),
)
def str6_sequences(spark: SparkSession, root: str) -> DataFrame:
    pages = sessions.session_pages(clicks(spark, root), "6 hours")
    return sessions.page_sequences(pages).withColumn(
        "page_view_sequence", F.array_join("page_view_sequence", " ")
    )


@query(
    "agg28_exp30_sessions_by_id",
    clicks_sql(
        f"""SELECT session_id, user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
        CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS duration_seconds,
        count(*) AS event_count, count(page) AS page_view_count, count(DISTINCT page) AS unique_urls_count,
        coalesce(array_to_string(list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)), ','), '')
          AS countries,
        first(page ORDER BY ts, event_id) FILTER (page IS NOT NULL) AS landing_page,
        last(page ORDER BY ts, event_id) FILTER (page IS NOT NULL) AS exit_page, count(page) <= 1 AS is_bounce,
        {_DEVICE.replace("user_agent", "any_value(fa)")} AS device_type,
        {_BROWSER.replace("user_agent", "any_value(fa)")} AS browser,
        strftime(min(ts), '%Y-%m-%d') AS date_partition
        FROM (SELECT *, CASE WHEN event_type = 'page_view' THEN url END AS page,
          first_value(user_agent IGNORE NULLS) OVER (PARTITION BY session_id, user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fa FROM clicks)
        GROUP BY session_id, user_id"""
    ),
)
def agg28(spark: SparkSession, root: str) -> DataFrame:
    return flat_sessions(sessions.sessions_by_id(clicks(spark, root)))


DAILY_SESSIONS = """SELECT strftime(to_timestamp(min(start_us) / 1000000.0) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_partition,
  user_id, count(*) AS total_sessions, CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds,
  CAST(sum(page_view_count) AS BIGINT) AS total_page_views, count(*) FILTER (is_bounce) AS bounce_sessions,
  CAST(sum(duration_seconds) AS DOUBLE) / count(*) AS avg_session_duration,
  CAST(sum(page_view_count) AS DOUBLE) / count(*) AS avg_page_views_per_session,
  CAST(count(*) FILTER (is_bounce) AS DOUBLE) / count(*) AS bounce_rate,
  min(start_us) AS first_us, max(end_us) AS last_us, CAST(any_value(nc) AS BIGINT) AS unique_countries
  FROM (SELECT z.*, d, nc FROM (SELECT *, (end_us + {gap} - 1) // 86400000000 AS d FROM z) z
    JOIN (SELECT user_id, d, count(DISTINCT c) FILTER (c <> '') AS nc
      FROM (SELECT user_id, (end_us + {gap} - 1) // 86400000000 AS d, unnest(string_split(countries, ',')) AS c FROM z)
      GROUP BY ALL) USING (user_id, d)) GROUP BY user_id, d"""


def flat_daily(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "first_us": micros("first_session_time"),
            "last_us": micros("last_session_time"),
            "unique_countries": F.col("unique_countries").cast("long"),
        }
    ).drop("first_session_time", "last_session_time")


def _daily(name: str, minutes: int) -> None:
    sql = DAILY_SESSIONS.replace("{gap}", str(minutes * 60_000_000))

    @query(name, clicks_sql(sql, *_session_ctes(minutes)))
    def run(spark: SparkSession, root: str) -> DataFrame:
        gap = f"{minutes} minutes"
        finished = sessions.sessions(clicks(spark, root), gap)
        return flat_daily(sessions.daily_session_metrics(finished, gap))


_daily("agg29_top6_set4_daily_sessions_30m", 30)
_daily("agg29_top6_set4_daily_sessions_6h", 360)


_Q = "CASE WHEN {0} IS NULL THEN 'null' ELSE concat('\"', {0}, '\"') END"


@query(
    "exp13_session_json",
    clicks_sql(
        f"""SELECT concat('{{"session_id":"', session_id, '","user_id":', user_id::VARCHAR, ',"start_time":"',
        strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.%f'), '","end_time":"',
        strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%S.%f'), '","duration_seconds":', duration_seconds::VARCHAR,
        ',"event_count":', event_count::VARCHAR, ',"page_view_count":', page_view_count::VARCHAR,
        ',"unique_urls_count":', unique_urls_count::VARCHAR, ',"countries":[',
        CASE WHEN countries = '' THEN '' ELSE concat('"', replace(countries, ',', '","'), '"') END,
        '],"landing_page":', {_Q.format("landing_page")}, ',"exit_page":', {_Q.format("exit_page")},
        ',"is_bounce":', is_bounce::VARCHAR, ',"device_type":', {_Q.format("device_type")},
        ',"browser":', {_Q.format("browser")}, ',"date_partition":"', date_partition, '"}}') AS value FROM z""",
        *_session_ctes(360),
    ),
)
def exp13_session(spark: SparkSession, root: str) -> DataFrame:
    finished = sessions.sessions(clicks(spark, root), "6 hours")
    return finished.select(ev.session_json().alias("value"))


@query(
    "exp27_session_extras",
    clicks_sql(
        """SELECT user_id, start_us, duration_seconds / 60.0::DOUBLE AS duration_minutes,
        duration_seconds > 1800 AS is_long_session,
        CASE WHEN countries <> '' THEN string_split(countries, ',')[1] END AS primary_country FROM z""",
        *_session_ctes(360),
    ),
)
def exp27(spark: SparkSession, root: str) -> DataFrame:
    finished = sessions.session_extras(sessions.sessions(clicks(spark, root), "6 hours"))
    return finished.select(
        "user_id",
        micros("start_time").alias("start_us"),
        "duration_minutes",
        "is_long_session",
        "primary_country",
    )


@query(
    "exp28_synthetic_session_id",
    clicks_sql(
        """SELECT user_id, epoch_us(a) AS start_us, CASE WHEN session_id IS NOT NULL THEN session_id ELSE
          concat('session_', CAST(user_id AS VARCHAR), '_', CAST(epoch_us(a) // 1000000 AS VARCHAR)) END AS session_id
        FROM s""",
        *[
            c.replace("SELECT *, CASE WHEN epoch_us", "SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN session_id END "
                      "AS session_id), CASE WHEN epoch_us")
            for c in _session_ctes(30)
        ],
    ),
)
def exp28(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("properties", "$.k").cast("int")
    anonymous = clicks(spark, root).withColumn("session_id", F.when(k % 2 == 0, F.col("session_id")))
    return sessions.sessions(anonymous).select("user_id", micros("start_time").alias("start_us"), "session_id")


# ---------------------------------------------------------------- running state over history

# Seven users who change country from event to event: long runs with growing country lists.
_ACTIVE_CTES = (
    """q AS (SELECT * REPLACE (user_id % 7 AS user_id,
        nullif(substr('USDEFRJPBR', CAST(2*(k % 6)+1 AS INT), 2), '') AS country,
        concat(CAST(user_id % 7 AS VARCHAR), '-', date_partition) AS session_id) FROM clicks)""",
    """r0 AS (SELECT *, CASE WHEN session_id IS NOT DISTINCT FROM lag(session_id) OVER o
        AND epoch_us(ts) - epoch_us(lag(ts) OVER o) <= {gap} THEN 0 ELSE 1 END AS st
      FROM q WHERE user_id IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "r1 AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r0)",
    """r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS event_count,
        list(country) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS l FROM r1)""",
)


def _roaming_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("properties", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in COUNTRY_CODES])
    u = F.col("user_id") % 7
    return events.withColumns(
        {
            "user_id": u,
            "country": F.get(codes, k % 6),
            "session_id": F.concat_ws("-", u.cast("string"), "date_partition"),
        }
    )


def active_sql(minutes: int, folded: bool = True) -> str:
    ctes = [c.replace("{gap}", str(minutes * 60_000_000)) for c in _ACTIVE_CTES]
    return clicks_sql(
        f"""SELECT user_id, session_id, epoch_us(ts) AS last_us, event_id, event_count,
        array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i), ',')
          AS countries, coalesce({_DEVICE}, 'desktop') AS device_type FROM r2""",
        *([ctes[0]] if folded else ["q AS (SELECT * FROM clicks)"]),
        *ctes[1:],
    )


def _active(name: str, minutes: int) -> None:
    @query(name, active_sql(minutes))
    def run(spark: SparkSession, root: str) -> DataFrame:
        out = tracking.active_sessions(_roaming_of(clicks(spark, root)), f"{minutes} minutes")
        return out.select(
            "user_id",
            "session_id",
            micros("last_activity").alias("last_us"),
            "event_id",
            F.col("event_count").cast("long").alias("event_count"),
            F.array_join("countries", ",").alias("countries"),
            "device_type",
        )


_active("str13_active_sessions_30m", 30)
_active("str13_active_sessions_12h", 720)


@query(
    "str13_session_timeouts",
    clicks_sql(
        """SELECT user_id, session_id, epoch_us(ts) AS last_us, epoch_us(ts) + 1800000000 AS timeout_us
        FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM clicks
          WHERE user_id IS NOT NULL)
        WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 1800000000"""
    ),
)
def str13_timeouts(spark: SparkSession, root: str) -> DataFrame:
    out = tracking.session_timeouts(clicks(spark, root))
    return out.select(
        "user_id",
        "session_id",
        micros("last_activity").alias("last_us"),
        micros("timeout_at").alias("timeout_us"),
    )


def views_sql(folded: bool) -> str:
    """Page views with their place; `folded`: three users with one session each."""
    return _VIEWS if folded else _VIEWS.replace(_FOLD, "")


_FOLD = " REPLACE (CAST(user_id % 3 AS BIGINT) AS user_id, 's' AS session_id)"
_VIEWS = """v AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS rn,
    row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts DESC, event_id DESC) AS back,
    min(ts) OVER (PARTITION BY user_id, session_id) AS started
  FROM (SELECT * REPLACE (CAST(user_id % 3 AS BIGINT) AS user_id, 's' AS session_id) FROM clicks)
  WHERE event_type = 'page_view')"""


def _long_journeys(spark: SparkSession, root: str) -> DataFrame:
    """Three users with one session each: journeys far longer than what is kept."""
    return clicks(spark, root).withColumns({"user_id": F.col("user_id") % 3, "session_id": F.lit("s")})


@query(
    "str14_journey_updates",
    clicks_sql(
        """SELECT user_id, session_id, event_id, url, epoch_us(ts) AS ts_us, country, rn - 1 AS position,
        CAST(least(rn, 50) AS BIGINT) AS page_count, epoch_us(started) AS started_us FROM v""",
        _VIEWS,
    ),
)
def str14(spark: SparkSession, root: str) -> DataFrame:
    out = tracking.journey_updates(_long_journeys(spark, root))
    return out.withColumns(
        {
            "ts_us": micros("ts"),
            "started_us": micros("started_at"),
            "page_count": F.col("page_count").cast("long"),
        }
    ).drop("ts", "started_at")


@query(
    "top5_latest_journeys",
    clicks_sql(
        """SELECT user_id, session_id, count(*) AS page_count, string_agg(url, ' ' ORDER BY ts, event_id) AS pages
        FROM v WHERE back <= 50 GROUP BY user_id, session_id""",
        _VIEWS,
    ),
)
def top5(spark: SparkSession, root: str) -> DataFrame:
    out = tracking.latest_journeys(_long_journeys(spark, root))
    return out.withColumns(
        {
            "page_count": F.col("page_count").cast("long"),
            "pages": F.array_join(F.transform("pages", lambda p: p["url"]), " "),
        }
    )
