"""Order events: derivation, wire format, watermark, seam totals, set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.functions.orders import at_or_above, below, event_time, gmv_sum, strict_gmv_delta, wire_json
from tidemark.operators import quality, seam, watermark
from tidemark.plans.registry import orders, orders_sql, query
from tidemark.schemas import MONEY_SUM
from tidemark.sources.derive import LATENESS_MS, PARTITIONS, wire_lines
from tidemark.sources.offsets import assign_partition, bucket, with_log_offsets, with_position
from tidemark.sources.wire import (
    accepted,
    decode_orders,
    in_time_range,
    quarantine,
    read_order_lines,
    write_order_lines,
)

GMV = "CASE WHEN event_type = 'order_created' THEN amount ELSE -amount END"
MONEY_SQL = "DECIMAL(38,2)"


def timed(spark: SparkSession, root: str) -> DataFrame:
    return orders(spark, root).withColumn("event_time", event_time(F.col("event_time_ms")))


def current_t(events: DataFrame) -> int:
    """T of the whole log, read once like the T of a commit: one small aggregate."""
    progress = events.groupBy("partition_id").agg(F.max("event_time_ms").alias("max_event_time_ms"))
    return watermark.safe_watermark(progress, LATENESS_MS, 0, PARTITIONS).head()[0]


@query(
    "src14_order_events",
    orders_sql(
        """SELECT event_id, order_id, event_type, amount, user_id, event_time_ms, partition_id,
        row_number() OVER (PARTITION BY partition_id ORDER BY emission) - 1 AS offset_id FROM oe"""
    ),
)
def src14(spark: SparkSession, root: str) -> DataFrame:
    return with_log_offsets(orders(spark, root)).drop("emission")


@query(
    "exp1_strict_gmv_delta",
    orders_sql(
        f"""SELECT event_type, count(*) AS events, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv
        FROM oe GROUP BY event_type"""
    ),
)
def exp1(spark: SparkSession, root: str) -> DataFrame:
    delta = strict_gmv_delta(F.col("event_type"), F.col("amount"))
    return (
        orders(spark, root)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(delta).cast(MONEY_SUM).alias("gmv"))
    )


@query(
    "exp2_gmv_by_partition",
    orders_sql(
        f"SELECT partition_id, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv FROM oe GROUP BY partition_id"
    ),
)
def exp2(spark: SparkSession, root: str) -> DataFrame:
    gmv = gmv_sum(F.col("event_type"), F.col("amount"))
    return orders(spark, root).groupBy("partition_id").agg(gmv.alias("gmv"))


_WIRE = """concat('{"event_id":"', event_id, '","order_id":"', order_id, '","event_type":"', event_type,
  '","amount":"', CAST(amount AS VARCHAR), '","user_id":', CAST(user_id AS VARCHAR),
  ',"event_time_ms":', CAST(event_time_ms AS VARCHAR), '}')"""


@query("exp3_wire_json", orders_sql(f"SELECT event_id, {_WIRE} AS value FROM oe"))
def exp3(spark: SparkSession, root: str) -> DataFrame:
    return orders(spark, root).select("event_id", wire_json().alias("value"))


@query(
    "exp4_event_time",
    orders_sql(
        """SELECT event_id, strftime(make_timestamp(event_time_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS event_time
        FROM oe"""
    ),
)
def exp4(spark: SparkSession, root: str) -> DataFrame:
    return timed(spark, root).select(
        "event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time")
    )


@query(
    "exp5_seam_predicates",
    orders_sql(
        """SELECT partition_id, count(*) FILTER (event_time_ms < t) AS below_t,
        count(*) FILTER (event_time_ms >= t) AS at_or_above_t FROM oe, wm GROUP BY partition_id"""
    ),
)
def exp5(spark: SparkSession, root: str) -> DataFrame:
    events = timed(spark, root)
    t = current_t(events)
    return events.groupBy("partition_id").agg(
        F.count_if(below(F.col("event_time"), t)).alias("below_t"),
        F.count_if(at_or_above(F.col("event_time"), t)).alias("at_or_above_t"),
    )


@query(
    "agg1_lake_side",
    orders_sql(
        f"""SELECT count(*) AS n, CAST(coalesce(sum({GMV}), 0) AS {MONEY_SQL}) AS gmv
        FROM oe, wm WHERE event_time_ms < t"""
    ),
)
def agg1(spark: SparkSession, root: str) -> DataFrame:
    events = timed(spark, root)
    return seam.lake_side(events, current_t(events))


@query(
    "agg2_fresh_side",
    orders_sql(
        f"""SELECT count(*) AS n, CAST(coalesce(sum({GMV}), 0) AS {MONEY_SQL}) AS gmv
        FROM oe, wm WHERE event_time_ms >= t"""
    ),
)
def agg2(spark: SparkSession, root: str) -> DataFrame:
    events = timed(spark, root)
    return seam.fresh_side(events, current_t(events))


SEAM_SQL = f"""SELECT max(t) AS watermark_t_ms, count(*) AS count, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv,
  count(*) FILTER (event_time_ms < t) AS lake_count, count(*) FILTER (event_time_ms >= t) AS ch_count,
  CAST(coalesce(sum({GMV}) FILTER (event_time_ms < t), 0) AS {MONEY_SQL}) AS lake_gmv,
  CAST(coalesce(sum({GMV}) FILTER (event_time_ms >= t), 0) AS {MONEY_SQL}) AS ch_gmv
  FROM oe, wm"""


@query("agg3_seam_totals", orders_sql(SEAM_SQL))
def agg3(spark: SparkSession, root: str) -> DataFrame:
    events = timed(spark, root)
    return seam.seam_totals(events, events, current_t(events))


@query("agg4_row_count", orders_sql("SELECT count(*) AS n FROM oe"))
def agg4(spark: SparkSession, root: str) -> DataFrame:
    return seam.row_count(orders(spark, root))


@query(
    "agg5_agg6_partition_progress",
    orders_sql(
        """SELECT partition_id, count(*) AS next_offset, max(event_time_ms) AS max_event_time_ms
        FROM oe GROUP BY partition_id"""
    ),
)
def agg5(spark: SparkSession, root: str) -> DataFrame:
    """Progress over the first and the second half of the log, merged."""
    log = with_log_offsets(orders(spark, root))
    first, second = log.where(F.col("offset_id") % 2 == 0), log.where(F.col("offset_id") % 2 == 1)
    return watermark.merge_progress(
        watermark.partition_progress(second), watermark.partition_progress(first)
    )


@query("agg7_safe_watermark", orders_sql("SELECT t AS watermark_ms FROM wm"))
def agg7(spark: SparkSession, root: str) -> DataFrame:
    events = orders(spark, root)
    progress = events.groupBy("partition_id").agg(F.max("event_time_ms").alias("max_event_time_ms"))
    return watermark.safe_watermark(progress, LATENESS_MS, 0, PARTITIONS)


@query(
    "agg9_ground_truth",
    orders_sql(
        f"""SELECT count(*) AS count, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv,
        count(*) FILTER (event_time_ms < t) AS count_below_t,
        CAST(coalesce(sum({GMV}) FILTER (event_time_ms < t), 0) AS {MONEY_SQL}) AS gmv_below_t FROM oe, wm"""
    ),
)
def agg9(spark: SparkSession, root: str) -> DataFrame:
    events = orders(spark, root)
    return seam.ground_truth(events, current_t(events))


@query("agg9_ids_below_t", orders_sql("SELECT event_id FROM oe, wm WHERE event_time_ms < t"))
def agg9_ids(spark: SparkSession, root: str) -> DataFrame:
    events = orders(spark, root)
    return seam.ids_below(events, current_t(events))


@query(
    "agg10_duplicate_stats",
    orders_sql("SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids FROM oe"),
)
def agg10(spark: SparkSession, root: str) -> DataFrame:
    return seam.duplicate_stats(orders(spark, root))


@query(
    "agg11_event_summary",
    orders_sql(
        f"""SELECT count(*) AS total, count(*) FILTER (event_type = 'order_created') AS created,
        count(*) FILTER (event_type <> 'order_created') AS cancelled, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv
        FROM oe"""
    ),
)
def agg11(spark: SparkSession, root: str) -> DataFrame:
    return seam.event_summary(orders(spark, root))


@query(
    "qry3_seam_json",
    orders_sql(
        """SELECT concat('{"watermark_t_ms":', CAST(watermark_t_ms AS VARCHAR), ',"count":', CAST(count AS VARCHAR),
        ',"gmv":"', CAST(gmv AS VARCHAR), '","lake_count":', CAST(lake_count AS VARCHAR),
        ',"ch_count":', CAST(ch_count AS VARCHAR), ',"lake_gmv":"', CAST(lake_gmv AS VARCHAR),
        '","ch_gmv":"', CAST(ch_gmv AS VARCHAR), '"}') AS value FROM s""",
        f"s AS ({SEAM_SQL})",
    ),
)
def qry3(spark: SparkSession, root: str) -> DataFrame:
    return seam.seam_json(agg3(spark, root))


# What decoding makes of the derived log lines.
_VERDICT = """CASE WHEN k % 97 = 96 THEN 'malformed_json'
  WHEN k % 101 = 100 THEN 'unknown_event_type' END"""


@query(
    "src3_quarantine",
    orders_sql(
        f"""SELECT partition_id, {_VERDICT} AS reject_reason, count(*) AS lines FROM oe
        WHERE {_VERDICT} IS NOT NULL GROUP BY ALL"""
    ),
)
def src3(spark: SparkSession, root: str) -> DataFrame:
    bad = quarantine(decode_orders(wire_lines(orders(spark, root))))
    return bad.groupBy("partition_id", "reject_reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src4_wire_decode",
    orders_sql(
        f"""SELECT event_id, order_id, event_type, amount, user_id, event_time_ms, partition_id FROM oe
        WHERE {_VERDICT} IS NULL"""
    ),
)
def src4(spark: SparkSession, root: str) -> DataFrame:
    good = accepted(decode_orders(wire_lines(orders(spark, root))))
    return good.drop("emission", "key")


@query(
    "src5_snk5_order_lines",
    orders_sql(
        f"""SELECT event_type, count(*) AS events, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv,
        CAST(sum(user_id) AS BIGINT) AS user_sum FROM oe GROUP BY event_type"""
    ),
)
def src5(spark: SparkSession, root: str) -> DataFrame:
    """Write the ground-truth lines and read them back."""
    path = ws.fresh_folder(spark, "order-lines")
    write_order_lines(orders(spark, root), path)
    return (
        read_order_lines(spark, path)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            gmv_sum(F.col("event_type"), F.col("amount")).alias("gmv"),
            F.sum("user_id").alias("user_sum"),
        )
    )


@query(
    "src10_bounded_range",
    orders_sql(
        """SELECT partition_id, count(*) AS events, min(event_time_ms) AS first_ms, max(event_time_ms) AS last_ms
        FROM oe WHERE event_time_ms >= 1700000002000 AND event_time_ms < 1700000020000 GROUP BY partition_id"""
    ),
)
def src10(spark: SparkSession, root: str) -> DataFrame:
    bounded = in_time_range(
        timed(spark, root),
        "event_time",
        F.timestamp_millis(F.lit(1_700_000_002_000)),
        F.timestamp_millis(F.lit(1_700_000_020_000)),
    )
    return bounded.groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_time_ms").alias("first_ms"),
        F.max("event_time_ms").alias("last_ms"),
    )


@query(
    "snk6_keyed_publish",
    orders_sql(
        """SELECT count(*) AS events, count(DISTINCT order_id) AS orders, CAST(0 AS BIGINT) AS split_orders,
        CAST(0 AS BIGINT) AS inverted_orders, CAST(0 AS BIGINT) AS offset_gaps FROM oe"""
    ),
)
def snk6(spark: SparkSession, root: str) -> DataFrame:
    """Equal keys share a partition, a creation precedes its cancellation, offsets have no gaps."""
    published = with_position(
        assign_partition(orders(spark, root).drop("partition_id"), "order_id", PARTITIONS),
        ["partition_id"],
        [F.col("emission")],
        bucket(F.col("emission"), 1 << 20),
        "offset_id",
    )
    per_order = published.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("partition_id") != F.max("partition_id")).alias("split"),
        F.max(F.when(F.col("event_type") == "order_created", F.col("offset_id"))).alias("created_at"),
        F.max(F.when(F.col("event_type") == "order_cancelled", F.col("offset_id"))).alias("cancelled_at"),
    )
    orders_seen = per_order.agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if("split").alias("split_orders"),
        F.count_if(F.col("cancelled_at") < F.col("created_at")).alias("inverted_orders"),
    )
    gaps = (
        published.groupBy("partition_id")
        .agg((F.max("offset_id") + 1 - F.count_distinct("offset_id")).alias("g"))
        .agg(F.coalesce(F.sum("g"), F.lit(0)).alias("offset_gaps"))
    )
    return orders_seen.withColumn("offset_gaps", gaps.scalar())


@query(
    "jn2_set3_id_sets",
    orders_sql(
        """SELECT count(*) AS common, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS spurious,
        CAST(0 AS BIGINT) AS duplicated FROM oe, wm WHERE event_time_ms < t"""
    ),
)
def jn2(spark: SparkSession, root: str) -> DataFrame:
    """Ids below T straight from the events against ids that went over the wire."""
    events = orders(spark, root)
    t = current_t(events)
    over_the_wire = accepted(decode_orders(events.select(wire_json().alias("value"))))
    return quality.set_summary(seam.ids_below(events, t), seam.ids_below(over_the_wire, t))


@query(
    "set3_missing_ids",
    orders_sql(
        f"""SELECT event_id, CAST(1 AS BIGINT) AS in_truth, CAST(0 AS BIGINT) AS in_landed, 'missing' AS problem
        FROM oe WHERE {_VERDICT} IS NOT NULL"""
    ),
)
def set3(spark: SparkSession, root: str) -> DataFrame:
    """What the faulty log loses: exactly the lines decoding rejects."""
    events = orders(spark, root)
    return quality.set_difference(events, accepted(decode_orders(wire_lines(events))))


@query(
    "jn3_order_lifecycle",
    orders_sql(
        f"""SELECT order_id, min(event_time_ms) FILTER (event_type = 'order_created') AS created_ms,
        max(event_time_ms) FILTER (event_type = 'order_cancelled') AS cancelled_ms,
        CAST(sum({GMV}) AS {MONEY_SQL}) AS net_amount,
        CASE WHEN count(*) FILTER (event_type = 'order_cancelled') > 0 THEN 'order_cancelled'
          ELSE 'order_created' END AS status
        FROM oe GROUP BY order_id"""
    ),
)
def jn3(spark: SparkSession, root: str) -> DataFrame:
    return quality.order_lifecycle(orders(spark, root))
