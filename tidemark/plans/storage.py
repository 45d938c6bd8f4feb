"""Tiers, keyed values, replay, retention, ingest, search and data-quality queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.functions import ingest as rules
from tidemark.operators import ingest, quality, search, tiers
from tidemark.plans.orders import GMV, MONEY_SQL
from tidemark.plans.registry import clicks, clicks_sql, micros, orders, orders_sql, query, text
from tidemark.schemas import INGEST_EVENT
from tidemark.sources.keyvalue import KeyValue
from tidemark.sources.tables import table
from tidemark.streaming import sinks

# A policy under which the month of test events spans all three tiers.
AS_OF = dt.datetime(2024, 2, 12, 0, 0, 0)
POLICY = tiers.RetentionPolicy(hot_days=20, warm_months=1)
HOT_FROM, WARM_FROM = POLICY.hot_cutoff(AS_OF), POLICY.warm_cutoff(AS_OF)
START, END = dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 28, 18)


def _t(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"


# ---------------------------------------------------------------- tiers


@query(
    "src11_top3_warm_range",
    clicks_sql(
        f"""SELECT event_id, epoch_us(ts) AS ts_us, url FROM clicks
        WHERE ts >= {_t(START)} AND ts < {_t(END)}"""
    ),
)
def src11(spark: SparkSession, root: str) -> DataFrame:
    out = tiers.ordered_range(clicks(spark, root), START, END)
    return out.select("event_id", micros("ts").alias("ts_us"), "url")


@query(
    "src12_snk10_archive",
    clicks_sql(
        f"""SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS ts_s, date_partition,
        CAST(strftime(ts, '%H') AS INT) AS hour, '1.0' AS archive_version, 'cold' AS tier, 7 AS retention_years
        FROM clicks WHERE ts >= {_t(START)} AND ts < {_t(START + dt.timedelta(days=5))}"""
    ),
)
def src12(spark: SparkSession, root: str) -> DataFrame:
    """Write the archive in day and hour folders, read a time range back from it."""
    path = ws.fresh_folder(spark, "archive")
    stamped = rules.archive_stamp(clicks(spark, root), F.lit(AS_OF))
    tiers.write_archive(stamped, path)
    archive = spark.read.schema(
        "event_id string, ts timestamp, archive_version string, "
        "retention_policy struct<tier:string,retention_years:int>, date_partition string, hour int"
    ).json(path)
    found = tiers.archive_scan(archive, START, START + dt.timedelta(days=5))
    return found.select(
        "event_id",
        F.unix_seconds("ts").alias("ts_s"),
        "date_partition",
        "hour",
        "archive_version",
        "retention_policy.tier",
        "retention_policy.retention_years",
    )


@query(
    "src13_jn1_key_lookup",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def src13(spark: SparkSession, root: str) -> DataFrame:
    """Values of the keys another table names; absent keys give no row."""
    wanted = table(spark, root, "lineitem").where(F.col("l_returnflag") == "R")
    keys = wanted.select(F.col("l_orderkey").alias("o_orderkey"))
    return tiers.lookup(table(spark, root, "orders"), "o_orderkey", keys).select("o_orderkey", "o_totalprice")


@query(
    "src13_get_one",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 77, 777, 99999999)",
)
def src13_one(spark: SparkSession, root: str) -> DataFrame:
    found = tiers.lookup(table(spark, root, "orders"), "o_orderkey", [7, 77, 777, 99999999])
    return found.select("o_orderkey", "o_totalprice")


def _laid_out(spark: SparkSession, root: str) -> KeyValue:
    stored = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    values = KeyValue(ws.fresh_folder(spark, "orders-by-key"), "o_orderkey", stored.schema)
    values.write(stored)
    return values


@query(
    "src13_get_from_layout",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 77, 777, 99999999)",
)
def src13_layout(spark: SparkSession, root: str) -> DataFrame:
    """Four keys read from four of 64 folders."""
    return _laid_out(spark, root).get(spark, [7, 77, 777, 99999999])


@query(
    "jn1_lookup_from_layout",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def jn1_layout(spark: SparkSession, root: str) -> DataFrame:
    wanted = table(spark, root, "lineitem").where(F.col("l_returnflag") == "R")
    return _laid_out(spark, root).lookup(spark, wanted.select(F.col("l_orderkey").alias("o_orderkey")))


@query(
    "exp29_tier_of_event",
    clicks_sql(
        f"""SELECT CASE WHEN ts >= {_t(HOT_FROM)} THEN 'kafka' WHEN ts >= {_t(WARM_FROM)} THEN 'clickhouse'
        ELSE 'cold_storage' END AS tier, date_partition, count(*) AS events FROM clicks GROUP BY ALL"""
    ),
)
def exp29(spark: SparkSession, root: str) -> DataFrame:
    tier = tiers.tier_of(F.col("ts"), POLICY, AS_OF).alias("tier")
    return clicks(spark, root).groupBy(tier, "date_partition").agg(F.count(F.lit(1)).alias("events"))


_REPLAY = f"""SELECT event_id, CASE WHEN ts >= {_t(HOT_FROM)} THEN 'kafka' WHEN ts >= {_t(WARM_FROM)}
  THEN 'clickhouse' ELSE 'cold_storage' END AS source FROM clicks WHERE ts >= {_t(START)} AND ts < {_t(END)}"""


def _replayed(spark: SparkSession, root: str) -> DataFrame:
    stored = clicks(spark, root)
    return tiers.replay(stored, stored, stored, START, END, POLICY, AS_OF)


@query("snk14_set2_replay", clicks_sql(_REPLAY))
def snk14(spark: SparkSession, root: str) -> DataFrame:
    return _replayed(spark, root).select("event_id", "source")


@query("snk14_published_replay", clicks_sql(_REPLAY))
def snk14_published(spark: SparkSession, root: str) -> DataFrame:
    """The replay written to its target day by day; a day that is replayed again adds nothing."""
    target = f"{ws.fresh_folder(spark, 'replay')}/events"
    rows = _replayed(spark, root)
    days = (END.date() - START.date()).days + 1
    slices = 4
    for number in [*range(slices), 0]:
        first, last = (START.date() + dt.timedelta(days=days * k // slices) for k in (number, number + 1))
        day = F.to_date("ts")
        sinks.publish_batch(rows.where((day >= F.lit(first)) & (day < F.lit(last))), target, number)
    return sinks.read_batches(spark, target).select("event_id", "source")


@query(
    "agg30_replay_totals",
    clicks_sql(f"SELECT source, count(*) AS events FROM ({_REPLAY}) GROUP BY source"),
)
def agg30(spark: SparkSession, root: str) -> DataFrame:
    return tiers.replay_totals(_replayed(spark, root))


@query(
    "snk15_retention",
    clicks_sql(f"SELECT event_id, epoch_us(ts) AS ts_us FROM clicks WHERE ts >= {_t(WARM_FROM)}"),
)
def snk15(spark: SparkSession, root: str) -> DataFrame:
    kept = tiers.expire(clicks(spark, root), POLICY, AS_OF)
    return kept.select("event_id", micros("ts").alias("ts_us"))


@query(
    "snk9_warm_rows",
    clicks_sql(
        """SELECT event_id, user_id, session_id, event_type, coalesce(event_name, '') AS event_name,
        concat('{"k":', CAST(k AS VARCHAR), CASE WHEN user_agent IS NULL THEN ''
          ELSE concat(',"user_agent":"', user_agent, '"') END, '}') AS properties,
        url, coalesce(country, '') AS country, coalesce(city, '') AS city, epoch_us(ts) AS ts_us, date_partition
        FROM clicks"""
    ),
)
def snk9(spark: SparkSession, root: str) -> DataFrame:
    return tiers.warm_rows(clicks(spark, root)).withColumn("ts_us", micros("ts")).drop("ts")


# Every event is a put: key user, value event id, lifetime by event type (purchases never expire).
_TTL = "CASE event_type WHEN 'page_view' THEN 86400 WHEN 'purchase' THEN NULL ELSE 3600 * 24 * 5 END"
_KV_AS_OF = dt.datetime(2024, 1, 30, 0, 0, 0)
_KV_CTE = f"""kv AS (SELECT user_id, event_id AS value, ts AS put_time, {_TTL} AS ttl FROM clicks
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _kv(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    ttl = F.when(kind == "page_view", 86400).when(kind == "purchase", F.lit(None)).otherwise(3600 * 24 * 5)
    return tiers.latest_values(clicks(spark, root), "user_id", F.col("event_id"), "ts", ttl)


@query(
    "snk16_hot_values",
    clicks_sql(
        f"""SELECT user_id, value, epoch_us(put_time) AS put_us FROM kv
        WHERE ttl IS NULL OR put_time + INTERVAL 1 SECOND * ttl > {_t(_KV_AS_OF)}""",
        _KV_CTE,
    ),
)
def snk16(spark: SparkSession, root: str) -> DataFrame:
    live = tiers.alive(_kv(spark, root), F.lit(_KV_AS_OF))
    return live.select("user_id", "value", micros("put_time").alias("put_us"))


@query(
    "snk17_delete_keys",
    clicks_sql(
        "SELECT user_id, value FROM kv WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
        _KV_CTE,
    ),
)
def snk17(spark: SparkSession, root: str) -> DataFrame:
    overdrawn = table(spark, root, "customer").where(F.col("c_acctbal") < 0)
    keys = overdrawn.select(F.col("c_custkey").alias("user_id"))
    return tiers.without_keys(_kv(spark, root), "user_id", keys).select("user_id", "value")


@query(
    "snk17_deleted_flags",
    clicks_sql(
        """SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM kv) AS deleted
        FROM customer WHERE c_acctbal < 0""",
        _KV_CTE,
    ),
)
def snk17_flags(spark: SparkSession, root: str) -> DataFrame:
    overdrawn = table(spark, root, "customer").where(F.col("c_acctbal") < 0)
    keys = overdrawn.select(F.col("c_custkey").alias("user_id"))
    return tiers.deleted_flags(_kv(spark, root), "user_id", keys)


@query(
    "agg31_sorted_set",
    clicks_sql(
        """SELECT event_type AS key, url AS member, k AS score FROM clicks
        QUALIFY row_number() OVER (PARTITION BY event_type, url ORDER BY ts DESC) = 1"""
    ),
)
def agg31(spark: SparkSession, root: str) -> DataFrame:
    adds = clicks(spark, root).select(
        F.col("event_type").alias("key"),
        F.col("url").alias("member"),
        F.get_json_object("properties", "$.k").cast("int").alias("score"),
        "ts",
    )
    return tiers.sorted_set(adds, "key", "member", "score", "ts")


# ---------------------------------------------------------------- ingest


def _requests(spark: SparkSession, root: str) -> DataFrame:
    """Requests with faults in a known pattern of k."""
    k = F.get_json_object("properties", "$.k").cast("int")
    base = clicks(spark, root).withColumn("k", k)
    return base.select(
        "k",
        "ts",
        F.col("event_id").alias("request_id"),
        F.when(k % 10 != 0, F.col("user_id")).alias("user_id"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("session_id")).alias("session_id"),
        F.when(k % 13 == 0, F.lit(None))
        .when(k % 13 == 1, F.lit(""))
        .when(k % 13 == 2, F.repeat(F.lit("t"), 101))
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        "event_name",
        "properties",
        F.when(k % 17 == 0, F.repeat(F.lit("u"), 2049)).otherwise(F.col("url")).alias("url"),
        F.lit(None).cast("string").alias("referrer"),
        F.lit("agent").alias("user_agent"),
        F.lit("10.0.0.1").alias("ip_address"),
        F.when(k % 19 == 0, F.lit("USA")).otherwise(F.col("country")).alias("country"),
        "city",
    )


_REQ_CTES = (
    """q AS (SELECT k, ts, event_id AS request_id, CASE WHEN k % 10 <> 0 THEN user_id END AS user_id,
      CASE WHEN k % 3 = 0 THEN '' ELSE session_id END AS session_id,
      CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('t', 101) ELSE event_type END AS event_type,
      event_name, CASE WHEN k % 17 = 0 THEN repeat('u', 2049) ELSE url END AS url,
      CASE WHEN k % 19 = 0 THEN 'USA' ELSE country END AS country, city FROM clicks)""",
    """r AS (SELECT *, concat_ws(',', CASE WHEN event_type IS NULL THEN 'event_type_missing' END,
      CASE WHEN length(event_type) = 0 THEN 'event_type_empty' END,
      CASE WHEN length(event_type) > 100 THEN 'event_type_too_long' END,
      CASE WHEN length(url) > 2048 THEN 'url_too_long' END,
      CASE WHEN length(country) > 2 THEN 'country_too_long' END) AS reasons FROM q)""",
)


@query(
    "exp22_ingest_validation",
    clicks_sql("SELECT request_id, reasons FROM r WHERE reasons <> ''", *_REQ_CTES),
)
def exp22(spark: SparkSession, root: str) -> DataFrame:
    bad = ingest.rejected(ingest.validate(_requests(spark, root)))
    return bad.select("request_id", F.array_join("reject_reasons", ",").alias("reasons"))


@query(
    "exp25_send_batches",
    clicks_sql(
        """SELECT concat('batch_', CAST(epoch_us(ts) // 3600000000 * 3600 AS VARCHAR)) AS send_batch_id, count(*) AS events,
        min(epoch_us(ts) // 1000) AS first_ms FROM clicks GROUP BY 1"""
    ),
)
def exp25_batches(spark: SparkSession, root: str) -> DataFrame:
    """Events sent in hourly batches, each named by the second it was sent."""
    sent = F.date_trunc("hour", "ts")
    stamped = rules.producer_stamp(clicks(spark, root), sent, None)
    return stamped.groupBy("send_batch_id").agg(
        F.count(F.lit(1)).alias("events"), F.min(F.unix_millis("ts")).alias("first_ms")
    )


@query(
    "exp23_exp25_ingest_enrichment",
    clicks_sql(
        """SELECT request_id, CASE WHEN session_id = '' THEN concat('session_',
          CAST(epoch_us(ts) // 1000000 AS VARCHAR)) ELSE session_id END AS session_id,
        coalesce(event_name, event_type) AS event_name, strftime(ts, '%Y-%m-%d') AS date_partition, 'api' AS source,
        epoch_us(ts) // 1000 AS producer_timestamp, 'producer_0' AS producer_id, true AS has_event_id
        FROM r WHERE reasons = ''""",
        *_REQ_CTES,
    ),
)
def exp23(spark: SparkSession, root: str) -> DataFrame:
    requests = _requests(spark, root).withColumn("received_at", F.col("ts"))
    done = ingest.single_events(requests, F.col("received_at"), ["request_id", "received_at"])
    stamped = rules.producer_stamp(done, F.col("received_at"), "producer_0")
    return stamped.select(
        "request_id",
        "session_id",
        "event_name",
        "date_partition",
        "source",
        "producer_timestamp",
        "producer_id",
        (F.length("event_id") == 36).alias("has_event_id"),
    )


def _batch_lines(spark: SparkSession, root: str) -> DataFrame:
    """One batch request per event: k % 4 copies of it, so every fourth batch is empty."""
    q = _requests(spark, root)
    one = F.struct(*INGEST_EVENT.names)
    copies = F.array_repeat(one, F.col("k") % 4)
    body = F.to_json(F.struct(F.concat(F.lit("b"), F.col("request_id")).alias("batch_id"), copies.alias("events")))
    return q.select("ts", "k", body.alias("value"))


_BATCH_CTE = """e AS (SELECT concat('b', request_id) AS batch_id, CAST(i AS INT) AS batch_index, r.*
  FROM r, unnest(range(k % 4)) AS n(i))"""


@query(
    "exp24_batch_unfold",
    clicks_sql(
        """SELECT batch_id, batch_index, CASE WHEN session_id = '' THEN concat('session_',
          CAST(epoch_us(ts) // 1000000 AS VARCHAR), '_', coalesce(CAST(user_id AS VARCHAR), 'None'))
          ELSE session_id END AS session_id, coalesce(event_name, event_type) AS event_name,
        'batch_api' AS source FROM e WHERE reasons = ''""",
        *_REQ_CTES,
        _BATCH_CTE,
    ),
)
def exp24(spark: SparkSession, root: str) -> DataFrame:
    batches = ingest.parse_batches(_batch_lines(spark, root))
    events = ingest.batch_events(batches, F.col("ts"))
    return events.select("batch_id", "batch_index", "session_id", "event_name", "source")


@query(
    "exp22_refused_batches",
    clicks_sql(
        """SELECT batch_id, 'batch_empty' AS reasons FROM (
          SELECT concat('b', request_id) AS batch_id FROM r WHERE k % 4 = 0)
        UNION ALL SELECT batch_id, string_agg(concat('events[', CAST(batch_index AS VARCHAR), ']: ', part), ','
          ORDER BY batch_index, pos) FROM (
          SELECT batch_id, batch_index, unnest(string_split(reasons, ',')) AS part,
            generate_subscripts(string_split(reasons, ','), 1) AS pos FROM e WHERE reasons <> '') GROUP BY batch_id""",
        *_REQ_CTES,
        _BATCH_CTE,
    ),
)
def exp22_batches(spark: SparkSession, root: str) -> DataFrame:
    refused = ingest.refused_batches(ingest.parse_batches(_batch_lines(spark, root)))
    return refused.select("batch_id", F.array_join("batch_reject_reasons", ",").alias("reasons"))


@query(
    "agg32_batch_outcomes",
    clicks_sql(
        """SELECT batch_id, count(*) FILTER ((k + batch_index) % 5 <> 0) AS processed_count,
        count(*) FILTER ((k + batch_index) % 5 = 0) AS failed_count FROM e WHERE reasons = '' GROUP BY batch_id""",
        *_REQ_CTES,
        _BATCH_CTE,
    ),
)
def agg32(spark: SparkSession, root: str) -> DataFrame:
    """Every fifth event of a batch is not delivered."""
    sent = ingest.batch_events(ingest.parse_batches(_batch_lines(spark, root)), F.col("ts"))
    return ingest.batch_outcomes(sent, (F.col("k") + F.col("batch_index")) % 5 != 0)


@query(
    "exp26_archive_stamp",
    clicks_sql(
        """SELECT event_id, '2024-02-12 00:00:00' AS archived_at, '1.0' AS archive_version, 'cold' AS tier,
        7 AS retention_years FROM clicks"""
    ),
)
def exp26(spark: SparkSession, root: str) -> DataFrame:
    out = rules.archive_stamp(clicks(spark, root), F.lit(AS_OF))
    return out.select(
        "event_id",
        text("archived_at").alias("archived_at"),
        "archive_version",
        "retention_policy.tier",
        "retention_policy.retention_years",
    )


# ---------------------------------------------------------------- search

_HITS = """SELECT event_id, ts FROM clicks WHERE event_type = 'purchase' OR event_name = 'e3'
  OR regexp_matches(url, '(^|/)42$') OR k = 42 OR user_agent LIKE '%Firefox%'"""
_QUERY = "Purchase, e3 42 firefox"


def _hits(spark: SparkSession, root: str) -> DataFrame:
    return search.search(search.search_index(clicks(spark, root)), _QUERY)


@query("qry2_search_hits", clicks_sql(f"SELECT event_id FROM ({_HITS})"))
def qry2(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root).select("event_id")


@query("qry2_search_total", clicks_sql(f"SELECT count(*) AS total FROM ({_HITS})"))
def qry2_total(spark: SparkSession, root: str) -> DataFrame:
    return search.search_total(_hits(spark, root))


@query(
    "top4_search_page",
    clicks_sql(
        f"SELECT event_id, epoch_us(ts) AS ts_us FROM ({_HITS}) ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10"
    ),
)
def top4(spark: SparkSession, root: str) -> DataFrame:
    page = search.search_page(_hits(spark, root), size=20, start=10)
    return page.select("event_id", micros("ts").alias("ts_us"))


@query(
    "snk13_search_index",
    clicks_sql(
        """SELECT '2024-01' AS month, count(*) AS events FROM clicks
        WHERE ts < TIMESTAMP '2024-02-01' HAVING count(*) > 0"""
    ),
)
def snk13(spark: SparkSession, root: str) -> DataFrame:
    """Index everything twice; an id stays one row."""
    twice = clicks(spark, root).unionByName(clicks(spark, root))
    return search.index_count(search.search_index(twice))


# ---------------------------------------------------------------- data quality


def _redelivered(spark: SparkSession, root: str) -> DataFrame:
    """The log with every seventh event delivered three times."""
    events = orders(spark, root)
    copies = F.when(F.col("order_id").cast("long") % 7 == 0, 3).otherwise(1)
    return events.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


@query(
    "plan1_deduplicate",
    orders_sql("SELECT event_id, order_id, event_type, amount, user_id, event_time_ms FROM oe"),
)
def plan1(spark: SparkSession, root: str) -> DataFrame:
    unique = quality.deduplicate(_redelivered(spark, root), "event_id", F.struct("emission", "copy"))
    return unique.drop("emission", "copy", "partition_id")


@query(
    "plan2_late_events",
    orders_sql(
        f"""SELECT count(*) AS late_events, CAST(coalesce(sum({GMV}), 0) AS {MONEY_SQL}) AS late_gmv
        FROM oe WHERE k % 9 = 0 AND event_time_ms - 3000 < 1700000000000 + emission - 2000"""
    ),
)
def plan2(spark: SparkSession, root: str) -> DataFrame:
    """Every ninth order is three seconds late; T follows two seconds behind the emission."""
    k = F.col("order_id").cast("long")
    arrivals = orders(spark, root).withColumns(
        {
            "t_at_arrival_ms": F.when(k % 9 == 0, F.lit(1_700_000_000_000) + F.col("emission") - 2000).otherwise(0),
            "event_time_ms": F.when(k % 9 == 0, F.col("event_time_ms") - 3000).otherwise(F.col("event_time_ms")),
        }
    )
    return quality.late_summary(arrivals)


@query(
    "plan3_partition_skew",
    orders_sql(
        """SELECT partition_id, events, m AS max_event_time_ms, max(m) OVER () - m AS lag_ms
        FROM (SELECT partition_id, count(*) AS events, max(event_time_ms) AS m FROM oe GROUP BY partition_id)"""
    ),
)
def plan3(spark: SparkSession, root: str) -> DataFrame:
    return quality.partition_skew(orders(spark, root))


# Orders by day; the fresh copy loses every 500th event and doubles the amount of one day.
_DRIFT_CTES = (
    """d AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) a
      FROM orders)""",
    "l AS (SELECT day, count(*) AS lake_count, CAST(sum(a) AS DECIMAL(38,2)) AS lake_gmv FROM d GROUP BY day)",
    """f AS (SELECT day, count(*) AS fresh_count,
      CAST(sum(CASE WHEN day = DATE '1996-07-01' THEN 2 * a ELSE a END) AS DECIMAL(38,2)) AS fresh_gmv
      FROM d WHERE k % 500 <> 0 GROUP BY day)""",
    """j AS (SELECT day, coalesce(fresh_count, 0) AS fresh_count, coalesce(fresh_gmv, 0) AS fresh_gmv,
      coalesce(lake_count, 0) AS lake_count, coalesce(lake_gmv, 0) AS lake_gmv FROM f FULL JOIN l USING (day))""",
)


@query(
    "plan5_daily_reconciliation",
    "WITH "
    + ",\n".join(_DRIFT_CTES)
    + """ SELECT strftime(day, '%Y-%m-%d') AS day, fresh_count, CAST(fresh_gmv AS DECIMAL(38,2)) AS fresh_gmv, lake_count,
    CAST(lake_gmv AS DECIMAL(38,2)) AS lake_gmv,
    abs(fresh_count - lake_count) / CAST(lake_count AS DOUBLE) > 0.001
      OR abs(fresh_gmv - lake_gmv) / CAST(lake_gmv AS DOUBLE) > 0.001 AS alert FROM j""",
)
def plan5(spark: SparkSession, root: str) -> DataFrame:
    lake = table(spark, root, "orders").select(
        "o_orderkey",
        F.lit("order_created").alias("event_type"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
    )
    faulty = F.to_date("event_time") == F.lit("1996-07-01").cast("date")
    fresh = lake.where(F.col("o_orderkey") % 500 != 0).withColumn(
        "amount", F.when(faulty, (F.col("amount") * 2).cast("decimal(18,2)")).otherwise(F.col("amount"))
    )
    out = quality.reconcile_daily(fresh, lake).drop("count_drift", "gmv_drift")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "plan7_salted_totals",
    orders_sql(
        f"""SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, count(*) AS events,
        CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv FROM oe GROUP BY ALL"""
    ),
)
def plan7(spark: SparkSession, root: str) -> DataFrame:
    """A third of all events belongs to one user."""
    u = F.col("user_id")
    hot = orders(spark, root).withColumn("user_id", F.when(u % 3 == 0, F.lit(0)).otherwise(u))
    return quality.salted_totals(hot, "user_id")


@query(
    "plan8_exact_distinct",
    clicks_sql(
        """SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS window_start, count(DISTINCT user_id) AS exact_users,
        true AS within_5_percent FROM clicks GROUP BY ALL"""
    ),
)
def plan8(spark: SparkSession, root: str) -> DataFrame:
    out = quality.distinct_users(clicks(spark, root))
    return out.select(
        text("window_start").alias("window_start"),
        "exact_users",
        (F.col("relative_error") <= 0.05).alias("within_5_percent"),
    )


@query(
    "plan8_sketch_panes_7d",
    clicks_sql(
        """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, country, count(*) AS events,
          count(DISTINCT date_trunc('hour', ts)) AS panes, count(DISTINCT user_id) AS exact_users,
          CAST(0 AS BIGINT) AS users_beyond_bound, CAST(0 AS BIGINT) AS bytes_beyond_bound
        FROM (SELECT *, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s
          FROM clicks) GROUP BY s, country"""
    ),
)
def plan8_panes(spark: SparkSession, root: str) -> DataFrame:
    """Users per country over seven days, day by day, from stored hourly sketches, beside the exact count.

    Bounds: 5 % of the exact count (three standard errors of 4096 registers), but at least one user, and
    4096 bytes and a header of 64 for a pane. What exceeds them is returned as a number.
    """
    events = clicks(spark, root)
    path = ws.fresh_folder(spark, "panes")
    quality.user_panes(events).write.parquet(path)
    estimated = quality.users_over(spark.read.parquet(path), "7 days", "1 day")
    users = events.groupBy("country", "user_id", F.to_date("ts").alias("day")).agg(F.lit(1).alias("_"))
    exact = (
        users.withColumn("start", F.explode(F.sequence(F.date_sub("day", 6), F.col("day"))))
        .groupBy("start", "country")
        .agg(F.count_distinct("user_id").alias("exact_users"))
        .select(F.col("start").cast("timestamp").alias("_start"), F.col("country").alias("_country"), "exact_users")
    )
    same = (F.col("window_start") == F.col("_start")) & F.col("country").eqNullSafe(F.col("_country"))
    off = F.abs(F.col("estimated_users") - F.col("exact_users"))
    bound = F.greatest(F.ceil(F.col("exact_users") * 0.05), F.lit(1))
    return estimated.join(exact, same).select(
        text("window_start").alias("window_start"),
        "country",
        "events",
        "panes",
        "exact_users",
        F.greatest(off - bound, F.lit(0)).cast("long").alias("users_beyond_bound"),
        F.greatest(F.col("largest_pane_bytes") - 4096 - 64, F.lit(0)).cast("long").alias("bytes_beyond_bound"),
    )


@query(
    "plan10_event_reconciliation",
    orders_sql(
        """SELECT event_id, CAST(1 AS BIGINT) AS in_truth,
        CAST(CASE WHEN CAST(order_id AS BIGINT) % 50 = 0 THEN 0 ELSE 3 END AS BIGINT) AS in_landed,
        CASE WHEN CAST(order_id AS BIGINT) % 50 = 0 THEN 'missing' ELSE 'duplicate' END AS problem
        FROM oe WHERE CAST(order_id AS BIGINT) % 50 = 0 OR CAST(order_id AS BIGINT) % 7 = 0"""
    ),
)
def plan10(spark: SparkSession, root: str) -> DataFrame:
    """Row by row: the landed copy lost some events and holds others three times."""
    landed = _redelivered(spark, root).where(F.col("order_id").cast("long") % 50 != 0)
    return quality.set_difference(orders(spark, root), landed)


@query(
    "plan11_order_status",
    orders_sql(
        """SELECT status, count(*) AS orders, CAST(sum(net) AS DECIMAL(38,2)) AS net_amount FROM (
        SELECT order_id, max_by(event_type, emission) AS status,
          sum(CASE WHEN event_type = 'order_created' THEN amount ELSE -amount END) AS net FROM oe GROUP BY order_id)
        GROUP BY status"""
    ),
)
def plan11(spark: SparkSession, root: str) -> DataFrame:
    per_order = quality.order_lifecycle(orders(spark, root))
    return per_order.groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("net_amount").cast("decimal(38,2)").alias("net_amount")
    )
