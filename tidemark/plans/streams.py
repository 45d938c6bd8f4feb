"""Streaming jobs run over the stored tables until everything available has been read.

Append mode holds back windows that end after the watermark, so the SQL of these queries keeps
windows with window_end <= newest event - allowed delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.functions.events import event_json, with_defaults
from tidemark.operators import analytics, metrics, quality, seam, tiers
from tidemark.operators.rollup import Rollup
from tidemark.plans import clickstream as cs
from tidemark.plans.orders import GMV, MONEY_SQL, SEAM_SQL, _VERDICT
from tidemark.plans.registry import (
    REGISTRY,
    clicks,
    clicks_sql,
    clicks_stream,
    micros,
    orders,
    orders_sql,
    pairs,
    query,
    text,
)
from tidemark.plans.storage import AS_OF, POLICY, WARM_FROM, _t
from tidemark.schemas import LOG_RECORD
from tidemark.sources.derive import LATENESS_MS, PARTITIONS, wire_lines
from tidemark.sources.offsets import with_log_offsets
from tidemark.sources.tables import ROW_GROUP
from tidemark.sources.wire import decode_events, log_file_stream
from tidemark.streaming import fresh, keyed, landing, postings, rollups, session_state, sinks

# ---------------------------------------------------------------- landing

SEGMENTS = 3


def stage_log(
    spark: SparkSession,
    root: str,
    path: str,
    segments: int = SEGMENTS,
    events: DataFrame | None = None,
    one_file: bool = False,
) -> list[str]:
    """The order log (or that of `events`) as files, cut into segments that arrive one after the other.

    Inside a segment files have no order; a segment is landed as one micro-batch, so the
    offsets of a log partition still arrive in order. Each task writes what it holds of a segment;
    with `one_file` a segment is brought together into one file first. Row groups are small, so that
    one file too is read by many tasks.
    """
    end = orders(spark, root).agg(F.max("emission")).head()[0] + 1
    log = with_log_offsets(wire_lines(orders(spark, root) if events is None else events)).drop("key")
    segment = F.floor(F.col("emission") * segments / F.lit(end)).cast("int")
    staged = log.withColumn("segment", segment).drop("emission")
    if one_file:
        staged = staged.repartition("segment")
    staged.write.option("parquet.block.size", ROW_GROUP).partitionBy("segment").parquet(path)
    return [f"{path}/segment={i}" for i in range(segments)]


def land(spark: SparkSession, root: str) -> tuple[str, str]:
    """Let the log arrive segment by segment, land each, read all into the fresh tier."""
    base = ws.fresh_folder(spark, "landing")
    log, lake, fresh_table = f"{base}/log", f"{base}/lake", f"{base}/fresh"
    for i, segment in enumerate(stage_log(spark, root, f"{base}/staged")):
        ws.publish(spark, segment, f"{log}/{i}")
        landing.start_landing(
            log_file_stream(spark, log), lake, f"{base}/cp-lake", PARTITIONS, LATENESS_MS, gapless=True
        ).awaitTermination()
    fresh.start_fresh(log_file_stream(spark, log), fresh_table, f"{base}/cp-fresh").awaitTermination()
    return lake, fresh_table


def backlog(spark: SparkSession, root: str, segments: int = 24) -> str:
    """The whole log at once, one file per segment, each a second younger than the one before."""
    base = ws.fresh_folder(spark, "backlog")
    for i, segment in enumerate(stage_log(spark, root, f"{base}/staged", segments, one_file=True)):
        ws.publish(spark, segment, f"{base}/log/{i}")
        ws.set_age(spark, f"{base}/log/{i}", i)
    return base


def _landed_sql(select: str, *ctes: str) -> str:
    """SQL over the rows decoding accepts."""
    return orders_sql(
        select,
        f"good AS (SELECT * FROM oe WHERE {_VERDICT} IS NULL)",
        "gt AS (SELECT min(m) - 1000 AS t FROM (SELECT max(event_time_ms) m FROM good GROUP BY partition_id))",
        *ctes,
    )


@query("snk1_agg3_landed_seam", _landed_sql(SEAM_SQL.replace("FROM oe, wm", "FROM good, gt")))
def snk1(spark: SparkSession, root: str) -> DataFrame:
    lake, fresh_table = land(spark, root)
    commit = landing.last_commit(spark, lake)
    return seam.seam_totals(
        landing.lake_rows_below(spark, lake, commit.watermark_ms, commit),
        fresh.fresh_rows(spark, fresh_table),
        commit.watermark_ms,
    )


@query(
    "src6_snk2_lake_below_t",
    _landed_sql(
        f"""SELECT strftime(make_timestamp(event_time_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n,
        CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv FROM good, gt WHERE event_time_ms < t GROUP BY ALL"""
    ),
)
def src6(spark: SparkSession, root: str) -> DataFrame:
    lake, _ = land(spark, root)
    commit = landing.last_commit(spark, lake)
    rows = landing.lake_rows_below(spark, lake, commit.watermark_ms, commit)
    return rows.groupBy(F.date_format(landing.DAY, "yyyy-MM-dd").alias("day")).agg(*seam._totals())


@query(
    "src7_lake_rows",
    _landed_sql("SELECT event_id, order_id, event_type, amount, user_id, event_time_ms, partition_id FROM good"),
)
def src7(spark: SparkSession, root: str) -> DataFrame:
    lake, _ = land(spark, root)
    rows = landing.lake_rows(spark, lake)
    return rows.withColumn("event_time_ms", F.unix_millis("event_time")).drop(
        "event_time", "offset_id", landing.DAY
    )


@query(
    "src1_src8_agg8_resume_state",
    _landed_sql(
        """SELECT partition_id, next_offset, max_event_time_ms, t AS watermark_ms, true AS several_commits
        FROM (SELECT partition_id, count(*) AS next_offset FROM oe GROUP BY partition_id)
        JOIN (SELECT partition_id, max(event_time_ms) AS max_event_time_ms FROM good GROUP BY partition_id)
          USING (partition_id), gt"""
    ),
)
def src8(spark: SparkSession, root: str) -> DataFrame:
    lake, _ = land(spark, root)
    state = landing.resume_state(spark, lake)
    return state.select(
        F.explode("offsets").alias("partition_id", "next_offset"), "max_event_time_ms", "watermark_ms", "seq"
    ).select(
        "partition_id",
        "next_offset",
        F.element_at("max_event_time_ms", F.col("partition_id")).alias("max_event_time_ms"),
        "watermark_ms",
        (F.col("seq") > 1).alias("several_commits"),
    )


@query(
    "src3_landed_quarantine",
    orders_sql(
        f"""SELECT partition_id, {_VERDICT} AS reject_reason, count(*) AS lines FROM oe
        WHERE {_VERDICT} IS NOT NULL GROUP BY ALL"""
    ),
)
def src3_landed(spark: SparkSession, root: str) -> DataFrame:
    lake, _ = land(spark, root)
    bad = landing.rejected_lines(spark, lake)
    return bad.groupBy("partition_id", "reject_reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src2_snk3_snk4_fresh_tier",
    _landed_sql("SELECT event_id, order_id, event_type, amount, user_id, event_time_ms FROM good"),
)
def snk3(spark: SparkSession, root: str) -> DataFrame:
    _, fresh_table = land(spark, root)
    rows = fresh.fresh_rows(spark, fresh_table)
    return rows.withColumn("event_time_ms", F.unix_millis("event_time")).drop("event_time")


_ACCEPTED_SQL = _landed_sql(
    f"""SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids,
    CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv FROM good"""
)


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("event_id").alias("distinct_ids"), seam._totals()[1]
    )


@query("str9_bounded_landing", _ACCEPTED_SQL)
def str9(spark: SparkSession, root: str) -> DataFrame:
    """A backlog of 24 files landed one file per micro-batch, so by 24 commits."""
    base = backlog(spark, root)
    landing.start_landing(
        log_file_stream(spark, f"{base}/log", max_files=1), f"{base}/lake", f"{base}/cp", PARTITIONS, LATENESS_MS
    ).awaitTermination()
    return _accepted(landing.lake_rows(spark, f"{base}/lake"))


@query("str12_fresh_after_lost_checkpoint", _ACCEPTED_SQL)
def str12_lost(spark: SparkSession, root: str) -> DataFrame:
    """The fresh tier after its checkpoint is lost while the log goes on growing."""
    base = ws.fresh_folder(spark, "lost")
    segments = stage_log(spark, root, f"{base}/staged")
    for i, segment in enumerate(segments):
        ws.publish(spark, segment, f"{base}/log/{i}")
        if i != 1:
            fresh.start_fresh(
                log_file_stream(spark, f"{base}/log"), f"{base}/fresh", f"{base}/cp-{i}"
            ).awaitTermination()
    return _accepted(fresh.fresh_rows(spark, f"{base}/fresh"))


TRIMMED = 100


@query(
    "src1_trimmed_log",
    orders_sql(
        f"""SELECT tier, count(*) AS total, count(DISTINCT event_id) AS distinct_ids, CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv
        FROM o JOIN (VALUES ('lake'), ('fresh')) AS x(tier) ON true WHERE o >= {TRIMMED} AND {_VERDICT} IS NULL GROUP BY tier""",
        "o AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY emission) - 1 AS o FROM oe)",
    ),
)
def src1_trimmed(spark: SparkSession, root: str) -> DataFrame:
    """A log whose retention has cut the first hundred offsets of every partition, landed and read fresh."""
    base = ws.fresh_folder(spark, "trimmed")
    for segment in stage_log(spark, root, f"{base}/staged"):
        rows = spark.read.schema(LOG_RECORD).parquet(segment).where(F.col("offset_id") >= TRIMMED)
        landing.land_batch(rows, f"{base}/lake", PARTITIONS, LATENESS_MS)
        fresh.add_fresh(rows, f"{base}/fresh")
    tiers_ = {"lake": landing.lake_rows(spark, f"{base}/lake"), "fresh": fresh.fresh_rows(spark, f"{base}/fresh")}
    lake_total, fresh_total = (_accepted(rows).withColumn("tier", F.lit(name)) for name, rows in tiers_.items())
    return lake_total.unionByName(fresh_total)


def _commits(spark: SparkSession, table: str, commits: list[landing.Commit]) -> DataFrame:
    """One row per commit with its late rows counted from the table."""
    stated = spark.createDataFrame(
        [(c.seq, c.watermark_ms, c.batch_count, ",".join(map(str, c.idle))) for c in commits],
        "seq long, watermark_ms long, events long, idle string",
    )
    late = landing.late_rows(spark, table).groupBy("seq").agg(*seam._totals())
    return stated.join(late, "seq", "left").select(
        "seq", "watermark_ms", "events", "idle", F.coalesce("n", F.lit(0)).alias("late"),
        F.coalesce("gmv", F.lit(0)).cast("decimal(38,2)").alias("late_gmv"),
    )


def _commits_sql(batch: str, last: int, watermarks: list[str], idle: dict[int, str], lateness: str = "event_time_ms") -> list[str]:
    """Rows `g` with their batch, T of every commit by the SQL `watermarks` (over m, which has each partition's newest
    event up to each batch), and `c`, what is to be seen of each commit."""
    steps = ", ".join(f"(SELECT {w} FROM m) AS t{k}" for k, w in enumerate(watermarks))
    return [
        f"g0 AS (SELECT * REPLACE ({lateness} AS event_time_ms), floor(emission * {last + 1} / (SELECT max(emission) + 1 FROM oe)) AS segment FROM oe)",
        f"g AS (SELECT *, CAST({batch} AS INT) AS batch FROM g0 WHERE {_VERDICT} IS NULL)",
        """m AS (SELECT partition_id AS p, b, max(event_time_ms) AS ms FROM g JOIN (SELECT unnest(range(0, 9)) AS b) AS bs
          ON g.batch <= b GROUP BY ALL)""",
        f"w AS (SELECT {steps})",
        f"""t AS (SELECT * FROM (SELECT unnest(range(0, {last + 1})) AS batch,
          unnest([{", ".join(f"greatest({', '.join(f't{j}' for j in range(k + 1))})" for k in range(last + 1))}]) AS t FROM w))""",
        f"""c AS (SELECT CAST(g.batch + 1 AS BIGINT) AS seq, any_value(t.t) AS watermark_ms, count(*) AS events,
          CASE g.batch WHEN -1 THEN '' {" ".join(f"WHEN {k} THEN '{v}'" for k, v in idle.items())} ELSE '' END AS idle,
          count(*) FILTER (event_time_ms < b.t) AS late,
          CAST(coalesce(sum({GMV}) FILTER (event_time_ms < b.t), 0) AS {MONEY_SQL}) AS late_gmv
          FROM g JOIN t USING (batch) LEFT JOIN t AS b ON b.batch = g.batch - 1 GROUP BY g.batch)""",
    ]


def _least(batch: int, where: str = "true") -> str:
    return f"min(ms) FILTER (b = {batch} AND {where}) - 1000"


@query(
    "str2_idle_partition",
    orders_sql(
        "SELECT * FROM c",
        *_commits_sql(
            "CASE WHEN partition_id = 3 AND segment IN (1, 2) THEN 3 ELSE segment END",
            3,
            [_least(0), _least(1), _least(2, "p <> 3"), _least(3)],
            {2: "3"},
        ),
    ),
)
def str2(spark: SparkSession, root: str) -> DataFrame:
    """A commit a minute; partition 3 is silent for two and left out of T after ninety seconds.

    When it wakes, what lies below T by then goes to the side table; no row is lost.
    """
    base = ws.fresh_folder(spark, "idle")
    parts = stage_log(spark, root, f"{base}/staged", 4)
    log = None
    for k, path in enumerate(parts):
        rows = spark.read.schema(LOG_RECORD).parquet(path).withColumn("batch", F.lit(k))
        log = rows if log is None else log.unionByName(rows)
    held = (F.col("partition_id") == 3) & F.col("batch").isin(1, 2)
    log = log.withColumn("batch", F.when(held, 3).otherwise(F.col("batch")))
    commits = []
    for k in range(4):
        rows = log.where(F.col("batch") == k).drop("batch")
        commits.append(
            landing.land_batch(
                rows, f"{base}/lake", PARTITIONS, LATENESS_MS, late_aside=True, idle_ms=90_000, now_ms=k * 60_000
            )
        )
    return _commits(spark, f"{base}/lake", commits)


#: Every ninth order is stamped three seconds before it is sent.
_BACKDATED = "CASE WHEN k % 9 = 0 THEN event_time_ms - 3000 ELSE event_time_ms END"
_BACKDATED_CTES = _commits_sql("segment", 2, [_least(0), _least(1), _least(2)], {}, _BACKDATED)


def land_backdated(spark: SparkSession, root: str) -> tuple[str, str, list[landing.Commit]]:
    base = ws.fresh_folder(spark, "backdated")
    back = F.when(F.col("order_id").cast("long") % 9 == 0, 3000).otherwise(0)
    events = orders(spark, root).withColumn("event_time_ms", F.col("event_time_ms") - back)
    commits = []
    for segment in stage_log(spark, root, f"{base}/staged", events=events):
        rows = spark.read.schema(LOG_RECORD).parquet(segment)
        commits.append(landing.land_batch(rows, f"{base}/lake", PARTITIONS, LATENESS_MS, late_aside=True))
        fresh.add_fresh(rows, f"{base}/fresh")
    return f"{base}/lake", f"{base}/fresh", commits


@query("plan2_late_side_table", orders_sql("SELECT * FROM c", *_BACKDATED_CTES))
def plan2_late(spark: SparkSession, root: str) -> DataFrame:
    """What came below T, commit by commit, in the table beside the rows."""
    lake, _, commits = land_backdated(spark, root)
    return _commits(spark, lake, commits)


@query(
    "plan2_rollback_seam",
    orders_sql(
        f"""SELECT 'before' AS state, max(t.t) AS watermark_t_ms, (SELECT count(*) FROM g) - (SELECT sum(late) FROM c) AS n,
          CAST((SELECT sum({GMV}) FROM g) - (SELECT sum(late_gmv) FROM c) AS {MONEY_SQL}) AS gmv, (SELECT sum(late) FROM c) AS side_rows FROM t
        UNION ALL
        SELECT 'after', least((SELECT max(t) FROM t), coalesce((SELECT min(event_time_ms) FROM g JOIN t ON t.batch = g.batch - 1
          WHERE event_time_ms < t.t), 9e18)), (SELECT count(*) FROM g), CAST((SELECT sum({GMV}) FROM g) AS {MONEY_SQL}), 0""",
        *_BACKDATED_CTES,
    ).replace("(SELECT sum(late) FROM c)", "CAST((SELECT sum(late) FROM c) AS BIGINT)").replace("9e18", "9000000000000000"),
)
def plan2_rollback(spark: SparkSession, root: str) -> DataFrame:
    """The seam before and after T is moved back: without the late rows it is short, with T below them it is whole."""
    lake, fresh_table, _ = land_backdated(spark, root)
    out = None
    for state in ("before", "after"):
        commit = landing.last_commit(spark, lake) if state == "before" else landing.roll_back(spark, lake)
        below_t = landing.lake_rows_below(spark, lake, commit.watermark_ms, commit)
        row = seam.seam_totals(below_t, fresh.fresh_rows(spark, fresh_table), commit.watermark_ms)
        side = landing.late_rows(spark, lake, commit).agg(F.count(F.lit(1)).alias("side_rows"))
        row = row.withColumn("side_rows", side.scalar())
        row = row.select(F.lit(state).alias("state"), "watermark_t_ms", F.col("count").alias("n"), "gmv", "side_rows")
        out = row if out is None else out.unionByName(row)
    return out


class Killed(RuntimeError):
    """Stands for a job that dies."""


def land_with_crashes(spark: SparkSession, root: str) -> tuple[str, str, str]:
    """Land the log while the job dies before a commit, right after one, and before one again;
    the same crashes hit two writes in a row without a commit."""
    base = ws.fresh_folder(spark, "crash")
    log, lake = f"{base}/log", f"{base}/lake"
    first, second = f"{base}/naive-first", f"{base}/naive-second"
    crashes = ["before", "after", "before"]

    def publish(s: SparkSession, staged: str, target: str) -> bool:
        moment = crashes.pop(0) if crashes else None
        if moment == "before":
            raise Killed("before the commit")
        done = ws.publish(s, staged, target)
        if moment == "after":
            raise Killed("after the commit")
        return done

    landing.create_table(spark, lake)

    def handle(records: DataFrame, _: int) -> None:
        landing.land_batch(records, lake, PARTITIONS, LATENESS_MS, gapless=True, publish=publish)

    naive_crashes = [True, True]

    def fail_between(_: int) -> None:
        if naive_crashes and naive_crashes.pop():
            raise Killed("between the two writes")

    naive = sinks.dual_write(first, second, fail_between)
    for i, segment in enumerate(stage_log(spark, root, f"{base}/staged")):
        ws.publish(spark, segment, f"{log}/{i}")
        _until_done(log_file_stream(spark, log), f"{base}/cp", handle)
        _until_done(log_file_stream(spark, log), f"{base}/cp-naive", naive)
    return lake, first, second


def _until_done(stream: DataFrame, checkpoint: str, handle) -> None:
    for _ in range(10):
        try:
            sinks.start(stream, checkpoint, handle).awaitTermination()
            return
        except Exception as problem:
            if "Killed" not in str(problem):
                raise
    raise RuntimeError("the job never finished")


@query(
    "str11_plan4_crash_recovery",
    _landed_sql(
        f"""SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids,
        CAST(sum({GMV}) AS {MONEY_SQL}) AS gmv FROM good"""
    ),
)
def str11(spark: SparkSession, root: str) -> DataFrame:
    lake, _, _ = land_with_crashes(spark, root)
    rows = landing.lake_rows(spark, lake)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("event_id").alias("distinct_ids"),
        seam._totals()[1],
    )


@query(
    "snk11_plan6_plan9_naive_against_commit",
    orders_sql(
        """SELECT 'commit' AS mode, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS lost, true AS exact
        UNION ALL SELECT 'deduplicated', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true
        UNION ALL SELECT 'naive_second', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true
        UNION ALL SELECT 'naive_first', CAST(1 AS BIGINT), CAST(0 AS BIGINT), false"""
    ),
)
def snk11(spark: SparkSession, root: str) -> DataFrame:
    """Rows doubled (as yes or no) and lost under the same crashes: one commit against two plain
    writes, and the plain write repaired by dropping repeated positions."""
    lake, first, second = land_with_crashes(spark, root)
    where = ["partition_id", "offset_id"]
    committed = landing.read_table(spark, lake).select(*where)
    naive_first = spark.read.parquet(first).select(*where)
    naive_second = spark.read.parquet(second).select(*where)
    repaired = naive_first.dropDuplicates(where)
    # Written once: the four comparisons read it in even parts instead of numbering the log again.
    path = ws.fresh_folder(spark, "truth")
    with_log_offsets(orders(spark, root)).select(*where).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    truth = spark.read.parquet(path)

    def key(df: DataFrame) -> DataFrame:
        return df.select((F.col("partition_id").cast("long") * (1 << 48) + F.col("offset_id")).alias("event_id"))

    out = None
    for mode, rows in [
        ("commit", committed),
        ("naive_first", naive_first),
        ("naive_second", naive_second),
        ("deduplicated", repaired),
    ]:
        s = quality.set_summary(key(truth), key(rows)).select(
            F.lit(mode).alias("mode"),
            F.least("duplicated", F.lit(1)).alias("doubled"),
            F.col("missing").alias("lost"),
            ((F.col("duplicated") == 0) & (F.col("missing") == 0) & (F.col("spurious") == 0)).alias("exact"),
        )
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- rollups

CUT = "strftime(max(ts) - INTERVAL {s} SECOND, '%Y-%m-%d %H:%M:%S')"


def closed(sql: str, delay_seconds: int = 5, column: str = "window_end") -> str:
    """The rows of a windowed query whose window the watermark has passed."""
    cut = CUT.replace("{s}", str(delay_seconds))
    return f"SELECT * FROM ({sql}) WHERE {column} <= (SELECT {cut} FROM events)"


def run_rollup(spark: SparkSession, root: str, rollup: Rollup) -> DataFrame:
    base = ws.fresh_folder(spark, "rollup")
    rollups.start_rollup(
        clicks_stream(spark, root), rollup, f"{base}/table", f"{base}/cp"
    ).awaitTermination()
    return sinks.read_batches(spark, f"{base}/table").drop("batch_id")


def _listed(column: str):
    return F.array_join(
        F.transform(column, lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string"))), ","
    )


_STREAMED = {
    "str3_stream_event_type_metrics_1s": ("agg13_event_type_metrics_1s", lambda: metrics.event_type_metrics("1 second"), {}),
    "str3_stream_event_type_metrics_1h": ("agg13_event_type_metrics_1h", lambda: metrics.event_type_metrics("1 hour"), {}),
    "str3_stream_country_metrics_1h": (
        "agg14_country_metrics_1h",
        lambda: metrics.country_metrics("1 hour"),
        {"event_type_breakdown": pairs},
    ),
    "str3_stream_active_users_1m": ("agg15_active_users_1m", lambda: metrics.active_users("1 minute"), {}),
    "str3_stream_page_views_1h": (
        "agg16_top1_page_views_1h",
        lambda: metrics.page_view_metrics("1 hour"),
        {"top_urls": _listed},
    ),
    "str3_stream_errors_1h": ("agg17_error_metrics_1h", lambda: metrics.error_metrics("1 hour"), {"error_types": pairs}),
}


def _register_rollups() -> None:
    for name, (batch_name, make, shown) in _STREAMED.items():

        def run(spark, root, make=make, shown=shown):
            out = cs._texted(run_rollup(spark, root, make()))
            return out.withColumns({c: f(c) for c, f in shown.items()}) if shown else out

        query(name, closed(REGISTRY[batch_name].sql))(run)


_register_rollups()


@query("str1_str17_snk8_hourly_stats", closed(REGISTRY["agg18_hourly_stats"].sql))
def hourly(spark: SparkSession, root: str) -> DataFrame:
    out = run_rollup(spark, root, analytics.hourly_stats())
    return out.withColumn("window_end", text("window_end")).drop("window_start")


@query(
    "str17_stream_daily_user_metrics",
    closed(
        REGISTRY["agg20_daily_user_metrics"].sql, 5, "strftime(date_partition::DATE + 1, '%Y-%m-%d %H:%M:%S')"
    ),
)
def daily_users(spark: SparkSession, root: str) -> DataFrame:
    out = run_rollup(spark, root, analytics.daily_user_metrics())
    return out.withColumns({"first_us": micros("first_event_time"), "last_us": micros("last_event_time")}).drop(
        "window_start", "window_end", "first_event_time", "last_event_time"
    )


@query(
    "str17_stream_funnel",
    closed(
        REGISTRY["agg23_conversion_funnel"].sql, 5, "strftime(date_partition::DATE + 1, '%Y-%m-%d %H:%M:%S')"
    ),
)
def funnel(spark: SparkSession, root: str) -> DataFrame:
    return run_rollup(spark, root, analytics.conversion_funnel())


@query(
    "str17_stream_user_journeys",
    # A session closes a day after its last event, not at the end of its day.
    f"""SELECT * FROM ({REGISTRY["agg22_user_journeys"].sql})
    WHERE end_us + 86400000000 <= (SELECT epoch_us(max(ts)) - 5000000 FROM events)""",
)
def journeys(spark: SparkSession, root: str) -> DataFrame:
    out = run_rollup(spark, root, analytics.user_journeys())
    return out.withColumns({"start_us": micros("session_start"), "end_us": micros("session_end")}).drop(
        "session_start", "session_end"
    )


@query("win4_stream_global_metrics_1h", closed(REGISTRY["agg12_win4_global_metrics_1h"].sql))
def global_stream(spark: SparkSession, root: str) -> DataFrame:
    base = ws.fresh_folder(spark, "global")
    rollups.start_global_metrics(
        clicks_stream(spark, root), f"{base}/table", f"{base}/cp", "1 hour"
    ).awaitTermination()
    return cs._texted(sinks.read_batches(spark, f"{base}/table").drop("batch_id"))


def run_append(spark: SparkSession, closed_rows: DataFrame, name: str) -> DataFrame:
    base = ws.fresh_folder(spark, name)
    rollups.start_append(closed_rows, f"{base}/table", f"{base}/cp").awaitTermination()
    return sinks.read_batches(spark, f"{base}/table").drop("batch_id")


@query(
    "str4_stream_hop_windows",
    closed(
        clicks_sql(
            """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
            strftime(s + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, country, city,
            count(*) AS total_events, count(*) FILTER (event_type = 'error') AS error_count
            FROM (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS s
              FROM clicks, (SELECT unnest(range(24)) AS h) WHERE country IS NOT NULL)
            GROUP BY s, country, city"""
        )
    ),
)
def hop(spark: SparkSession, root: str) -> DataFrame:
    events = clicks_stream(spark, root).withWatermark("ts", "5 seconds")
    return cs._texted(run_append(spark, analytics.geo_analysis_stream(events), "hop"))


@query(
    "agg26_stream_geo_panes",
    clicks_sql(
        """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS pane, country, city, user_id,
        count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases,
        count(*) FILTER (event_type = 'error') AS errors FROM clicks WHERE country IS NOT NULL
          AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events)
        GROUP BY ALL"""
    ),
)
def panes(spark: SparkSession, root: str) -> DataFrame:
    """The stream lands panes; the sliding report is computed from the landed panes."""
    events = clicks_stream(spark, root).withWatermark("ts", "5 seconds")
    return run_append(spark, analytics.geo_panes(events), "panes").withColumn("pane", text("pane"))


@query(
    "agg26_stream_geo_report",
    clicks_sql(
        """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(s + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, country, city,
        count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
        avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS purchase_rate,
        count(*) FILTER (event_type = 'error') AS error_count,
        CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate
        FROM (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS s
          FROM clicks, (SELECT unnest(range(24)) AS h) WHERE country IS NOT NULL
            AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events))
        GROUP BY s, country, city HAVING count(*) >= 10"""
    ),
)
def geo_report(spark: SparkSession, root: str) -> DataFrame:
    """Users, purchase and error rate of every 24 hours, from the panes a stream has landed."""
    events = clicks_stream(spark, root).withWatermark("ts", "5 seconds")
    landed = run_append(spark, analytics.geo_panes(events), "geo")
    return cs._texted(analytics.geo_windows(landed, min_count=10))


@query(
    "src9_stream_decode",
    clicks_sql(
        """SELECT event_id, user_id, event_type, country, url, epoch_us(ts) AS ts_us, date_partition FROM clicks
        WHERE k % 13 <> 0"""
    ),
)
def stream_decode(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines of a topic, read as a stream; a cut-off line has no id and is left out."""
    base = ws.fresh_folder(spark, "topic")
    k = F.get_json_object("properties", "$.k").cast("int")
    text_of = event_json()
    lines = clicks(spark, root).select(
        F.lit(0).alias("partition_id"),
        F.col("event_id").cast("long").alias("offset_id"),
        F.when(k % 13 == 0, F.substring(text_of, 1, 9)).otherwise(text_of).alias("value"),
    )
    lines.write.parquet(f"{base}/log")
    decoded = decode_events(log_file_stream(spark, f"{base}/log")).where(F.col("event_id").isNotNull())
    events = with_defaults(decoded, F.lit("2024-06-01").cast("timestamp"))
    rollups.start_append(events, f"{base}/table", f"{base}/cp").awaitTermination()
    return sinks.read_batches(spark, f"{base}/table").select(
        "event_id", "user_id", "event_type", "country", "url", micros("ts").alias("ts_us"), "date_partition"
    )


@query(
    "str8_partition_min_watermark",
    clicks_sql(
        """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events
        FROM clicks WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT min(m) - INTERVAL 5 SECOND
          FROM (SELECT max(ts) AS m FROM clicks GROUP BY user_id % 4)) GROUP BY ALL"""
    ),
)
def partition_min(spark: SparkSession, root: str) -> DataFrame:
    """Four log partitions as four streams: hours close when the slowest one has passed them."""
    parts = [clicks_stream(spark, root).where(F.col("user_id") % 4 == p) for p in range(4)]
    events = rollups.per_partition_watermark(parts, "5 seconds")
    hours = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return run_append(spark, hours, "partition-min").select(text("w.start").alias("window_start"), "events")


# ---------------------------------------------------------------- sessions and keyed state

_SESSION_DROP = "unique_urls_count"


def _ended(sql: str, gap_minutes: int) -> str:
    """Sessions whose window (last event + gap) the watermark has passed."""
    return f"""SELECT * EXCLUDE ({_SESSION_DROP}) FROM ({sql})
      WHERE end_us + {gap_minutes * 60_000_000} <= (SELECT epoch_us(max(ts)) - 10000000 FROM events)"""


@query("str5_stream_sessions_30m", _ended(REGISTRY["agg27_sessions_30m"].sql, 30))
def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    out = run_append(spark, rollups.sessions_stream(clicks_stream(spark, root)), "sessions")
    return cs.flat_sessions(out.drop("session"))


_OVER = """over_ AS (SELECT * FROM (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS nxt FROM s)
  WHERE nxt IS NOT NULL OR epoch_us(b) + {gap} < (SELECT epoch_us(max(ts)) - 10000000 FROM events))"""


@query(
    "str5_stream_session_records_30m",
    clicks_sql(
        "SELECT z.* FROM z JOIN over_ ON z.user_id = over_.user_id AND z.start_us = epoch_us(over_.a)",
        *cs._session_ctes(30),
        _OVER.replace("{gap}", "1800000000"),
    ),
)
def stream_session_records(spark: SparkSession, root: str) -> DataFrame:
    """Whole records, different URLs included, of sessions that end in any of four micro-batches."""
    table = run_keyed(spark, clicks_stream(spark, root), session_state.session_job("30 minutes"), "records")
    return cs.flat_sessions(keyed.output(spark, table, "sessions").drop("opened", "batch_id"))


@query(
    "str6_stream_session_pages_6h",
    clicks_sql(
        """SELECT n.user_id, epoch_us(a) AS opened_us, row_number() OVER (PARTITION BY n.user_id, n.session_no ORDER BY ts, event_id) - 1
          AS position, page, epoch_us(ts) AS ts_us, event_id
        FROM n JOIN s ON n.user_id = s.user_id AND n.session_no = s.session_no WHERE page IS NOT NULL""",
        *cs._session_ctes(360),
    ),
)
def stream_session_pages(spark: SparkSession, root: str) -> DataFrame:
    """The page sequence of every session, written as the pages come, over four micro-batches."""
    table = run_keyed(spark, clicks_stream(spark, root), session_state.session_job("6 hours"), "pages")
    pages = keyed.output(spark, table, "pages").drop("batch_id")
    return pages.withColumns({"opened_us": micros("opened"), "ts_us": micros("ts")}).drop("opened", "ts")


@query(
    "str7_stream_daily_sessions_30m",
    closed(
        clicks_sql(
            cs.DAILY_SESSIONS.replace("{gap}", "1800000000").replace(
                "SELECT strftime", "SELECT strftime(make_timestamp((d + 1) * 86400000000), '%Y-%m-%d %H:%M:%S') "
                "AS day_end, strftime", 1
            ),
            *cs._session_ctes(30),
        ),
        10,
        "day_end",
    ).replace("SELECT * FROM", "SELECT * EXCLUDE (day_end) FROM", 1),
)
def stream_daily_sessions(spark: SparkSession, root: str) -> DataFrame:
    out = run_append(spark, rollups.daily_sessions_stream(clicks_stream(spark, root)), "daily")
    return cs.flat_daily(out)


def _active_rows(out: DataFrame) -> DataFrame:
    return out.select(
        "user_id",
        "session_id",
        micros("last_activity").alias("last_us"),
        "event_id",
        "event_count",
        F.array_join("countries", ",").alias("countries"),
        "device_type",
    )


def run_keyed(spark: SparkSession, events: DataFrame, job: keyed.Job, name: str) -> str:
    base = ws.fresh_folder(spark, name)
    keyed.start_keyed(events, f"{base}/table", f"{base}/cp", job).awaitTermination()
    return f"{base}/table"


@query(
    "str13_stream_active_sessions",
    f"""SELECT 'real' AS users, * FROM ({cs.active_sql(30, folded=False)})
    UNION ALL SELECT 'roaming', * FROM ({cs.active_sql(30)})""",
)
def stream_active(spark: SparkSession, root: str) -> DataFrame:
    """Every user's session after each event, over several micro-batches.

    One state holds the real users, with one country each, and seven who change country with every event:
    an event counts for its user (even keys) and for one of the seven (odd keys).
    """
    events = clicks_stream(spark, root)
    key = F.col("user_id") * 2
    both = events.withColumn("user_id", key).unionByName(cs._roaming_of(events).withColumn("user_id", key + 1))
    table = run_keyed(spark, both, keyed.active_job(), "active")
    out = _active_rows(keyed.output(spark, table, "active"))
    kind = F.when(F.col("user_id") % 2 == 0, "real").otherwise("roaming").alias("users")
    return out.select(kind, F.shiftright("user_id", 1).alias("user_id"), *out.columns[1:])


@query("str13_stream_active_sessions_hot", REGISTRY["str13_active_sessions_30m"].sql)
def stream_active_hot(spark: SparkSession, root: str) -> DataFrame:
    """The same for seven users with all events between them."""
    table = run_keyed(spark, cs._roaming_of(clicks_stream(spark, root)), keyed.active_job(), "active-hot")
    return _active_rows(keyed.output(spark, table, "active"))


@query(
    "str13_stream_timeouts",
    clicks_sql(
        """SELECT user_id, session_id, epoch_us(ts) AS last_us, epoch_us(ts) + 1800000000 AS timeout_us
        FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM clicks
          WHERE user_id IS NOT NULL)
        WHERE epoch_us(nxt) - epoch_us(ts) > 1800000000
           OR (nxt IS NULL AND epoch_us(ts) + 1800000000 < (SELECT epoch_us(max(ts)) - 10000000 FROM events))"""
    ),
)
def stream_timeouts(spark: SparkSession, root: str) -> DataFrame:
    """Every timeout the stream emits: users who came back later, and those the watermark has passed."""
    table = run_keyed(spark, clicks_stream(spark, root), keyed.active_job(), "timeouts")
    return keyed.output(spark, table, "gone").select(
        "user_id",
        "session_id",
        micros("last_activity").alias("last_us"),
        micros("timeout_at").alias("timeout_us"),
    )


def _view_rows(out: DataFrame) -> DataFrame:
    return out.select(
        "user_id",
        "session_id",
        "event_id",
        "url",
        micros("ts").alias("ts_us"),
        F.col("page_count").cast("long").alias("page_count"),
        micros("started_at").alias("started_us"),
    )


_STREAM_VIEWS = """SELECT user_id, session_id, event_id, url, epoch_us(ts) AS ts_us, CAST(least(rn, 50) AS BIGINT) AS page_count,
        epoch_us(started) AS started_us FROM v"""


@query("str14_stream_journeys", clicks_sql(_STREAM_VIEWS, cs.views_sql(folded=False)))
def stream_journeys(spark: SparkSession, root: str) -> DataFrame:
    """Every page view's place in its user's journey, over several micro-batches."""
    table = run_keyed(spark, clicks_stream(spark, root), keyed.journey_job(), "journeys")
    return _view_rows(keyed.output(spark, table, "views"))


def _long(events: DataFrame) -> DataFrame:
    return events.withColumns({"user_id": F.col("user_id") % 3, "session_id": F.lit("s")})


@query("str14_stream_journeys_hot", clicks_sql(_STREAM_VIEWS, cs.views_sql(folded=True)))
def stream_journeys_hot(spark: SparkSession, root: str) -> DataFrame:
    """The same for three journeys with all page views between them."""
    job = keyed.journey_job(idle="400 days")
    table = run_keyed(spark, _long(clicks_stream(spark, root)), job, "journeys-hot")
    return _view_rows(keyed.output(spark, table, "views"))


@query(
    "udx2_stream_latest_journeys",
    clicks_sql(
        """SELECT user_id, session_id, count(*) AS page_count, string_agg(url, ' ' ORDER BY ts, event_id) AS pages,
        any_value(n) AS views, epoch_us(any_value(started)) AS started_us
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session_id) AS n FROM v)
        WHERE back <= 50 GROUP BY user_id, session_id""",
        cs.views_sql(folded=True),
    ),
)
def stream_latest_journeys(spark: SparkSession, root: str) -> DataFrame:
    """The state the stream keeps: the newest pages of every journey."""
    job = keyed.journey_job(idle="400 days")
    table = run_keyed(spark, _long(clicks_stream(spark, root)), job, "latest")
    return keyed.state_rows(spark, table, job).select(
        "user_id",
        "session_id",
        F.size("pages").cast("long").alias("page_count"),
        F.array_join(F.transform("pages", lambda p: p["url"]), " ").alias("pages"),
        "views",
        micros("started_at").alias("started_us"),
    )


# ---------------------------------------------------------------- sinks


@query(
    "snk7_hot_event_type_metrics",
    "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) AS r "
    f"FROM ({closed(REGISTRY['agg13_event_type_metrics_1h'].sql)})) WHERE r = 1",
)
def hot(spark: SparkSession, root: str) -> DataFrame:
    """Only the newest window per event type stays visible."""
    base = ws.fresh_folder(spark, "hot")
    rollup = metrics.event_type_metrics("1 hour")
    partial = rollup.partial(clicks_stream(spark, root).withWatermark("ts", "5 seconds"))
    sink = sinks.hot_sink(f"{base}/table", "event_type_metrics")

    def handle(batch: DataFrame, batch_id: int) -> None:
        with sinks.staged(batch, f"{base}/partial", batch_id) as partials:
            sink(rollup.finish(partials), batch_id)

    sinks.start(partial, f"{base}/cp", handle).awaitTermination()
    return cs._texted(sinks.hot_view(spark, f"{base}/table", "event_type_metrics"))


@query(
    "snk12_agg24_tiered_store",
    clicks_sql(
        """SELECT (SELECT count(*) FROM clicks) AS warm_rows, (SELECT count(*) FROM clicks) AS indexed,
        (SELECT count(*) FROM clicks) AS hot_values,
        (SELECT count(DISTINCT date_trunc('minute', ts)) FROM clicks) AS minutes,
        (SELECT count(*) FROM clicks) AS counted,
        (SELECT count(*) FROM clicks WHERE user_id <> 0) AS counted_for_users"""
    ),
)
def tiered(spark: SparkSession, root: str) -> DataFrame:
    base = ws.fresh_folder(spark, "tiers")
    sinks.start(clicks_stream(spark, root), f"{base}/cp", sinks.tiered_store(base)).awaitTermination()

    def count(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    total = F.sum("events_count")
    everyone = sinks.stored_counters(spark, base)
    named = sinks.stored_counters(spark, base, per_user=True)
    return everyone.agg(F.count(F.lit(1)).alias("minutes"), total.alias("counted")).select(
        "minutes",
        "counted",
        named.agg(total).scalar().alias("counted_for_users"),
        count(sinks.read_batches(spark, f"{base}/warm")).alias("warm_rows"),
        count(sinks.stored_search_index(spark, base)).alias("indexed"),
        count(sinks.stored_values(spark, base)).alias("hot_values"),
    )


@query(
    "snk12_snk16_hot_values",
    clicks_sql(
        """SELECT event_id, concat('{"event_id":"', event_id, '","user_id":', user_id, ',"event_type":"', event_type, '","url":"', url, '"}')
          AS value, epoch_us(ts) AS put_us, epoch_us(ts) + 86400000000 AS expires_us
        FROM clicks WHERE epoch_us(ts) + 86400000000 > (SELECT epoch_us(max(ts)) FROM events)"""
    ),
)
def hot_values(spark: SparkSession, root: str) -> DataFrame:
    """Values of the last day over micro-batches that are folded every second one."""
    base = ws.fresh_folder(spark, "values")
    store = sinks.tiered_store(base, ttl_seconds=86_400, every=2)
    sinks.start(clicks_stream(spark, root), f"{base}/cp", store).awaitTermination()
    now = F.timestamp_micros(F.lit(clicks(spark, root).agg(F.max(micros("ts"))).head()[0]))
    return sinks.stored_values(spark, base, now).select(
        "event_id", "value", micros("put_time").alias("put_us"), micros("expires_at").alias("expires_us")
    )


@query(
    "snk7_hot_session_tables",
    clicks_sql(
        f"""SELECT 'session_summary' AS name, session_id AS key, max(epoch_us(b)) AS version_us FROM over_ GROUP BY session_id
        UNION ALL SELECT 'active_sessions', CAST(user_id AS VARCHAR), max(epoch_us(ts)) FROM clicks WHERE user_id IS NOT NULL GROUP BY user_id
        UNION ALL SELECT 'user_journey', concat(CAST(user_id AS VARCHAR), '/', session_id), max(epoch_us(ts)) FROM clicks
          WHERE user_id IS NOT NULL AND event_type = 'page_view' GROUP BY user_id, session_id""",
        *cs._session_ctes(30),
        _OVER.replace("{gap}", "1800000000"),
    ),
)
def hot_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Three keyed jobs on one stream, each feeding its hot table; the tables fold every second batch."""
    base = ws.fresh_folder(spark, "hot-sessions")
    jobs = {
        "session_summary": (session_state.session_job(), "sessions", F.col("session_id")),
        "active_sessions": (keyed.active_job(), "active", F.col("user_id").cast("string")),
        "user_journey": (keyed.journey_job(), "journeys", F.concat_ws("/", "user_id", "session_id")),
    }

    def handle(batch: DataFrame, number: int) -> None:
        def feed(name: str) -> None:
            made = keyed.batch_output(batch.sparkSession, f"{base}/state/{name}", jobs[name][1], number)
            sinks.hot_sink(f"{base}/{name}", name, every=2)(made, number)

        keyed.advance_all(batch, f"{base}/state", number, {name: job for name, (job, _, _) in jobs.items()}, feed)

    sinks.start(clicks_stream(spark, root), f"{base}/cp", handle).awaitTermination()
    out = None
    for name, (_, _, key) in jobs.items():
        rows = sinks.hot_view(spark, f"{base}/{name}", name)
        version = micros(sinks.HOT_TABLES[name][1]).alias("version_us")
        rows = rows.select(F.lit(name).alias("name"), key.alias("key"), version)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "snk18_fallback_route",
    clicks_sql(
        """SELECT CASE WHEN k % 5 = 0 THEN 'fallback' ELSE 'main' END AS route, event_id FROM clicks"""
    ),
)
def fallback(spark: SparkSession, root: str) -> DataFrame:
    """Every fifth event was not accepted by the log and is stored directly."""
    base = ws.fresh_folder(spark, "fallback")
    accepted = F.get_json_object("properties", "$.k").cast("int") % 5 != 0
    sink = sinks.split_sink(f"{base}/main", f"{base}/fallback", accepted)
    sinks.start(clicks_stream(spark, root), f"{base}/cp", sink).awaitTermination()
    parts = [
        sinks.read_batches(spark, f"{base}/{name}").select(F.lit(name).alias("route"), "event_id")
        for name in ("main", "fallback")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "snk15_retention_rewrite",
    clicks_sql(
        f"""SELECT date_partition, count(*) AS events, epoch_us(min(ts)) AS first_us FROM clicks
        WHERE ts >= {_t(WARM_FROM)} GROUP BY date_partition"""
    ),
)
def retention_rewrite(spark: SparkSession, root: str) -> DataFrame:
    """The warm table by day, then its rewrite under the retention policy."""
    base = ws.fresh_folder(spark, "retention")
    sinks.rewrite_by_day(clicks(spark, root), f"{base}/warm")
    warm = spark.read.parquet(f"{base}/warm").withColumn(
        "date_partition", F.date_format("date_partition", "yyyy-MM-dd")
    )
    sinks.rewrite_by_day(tiers.expire(warm, POLICY, AS_OF), f"{base}/kept")
    return (
        spark.read.parquet(f"{base}/kept")
        .groupBy(F.date_format("date_partition", "yyyy-MM-dd").alias("date_partition"))
        .agg(F.count(F.lit(1)).alias("events"), F.min(micros("ts")).alias("first_us"))
    )


@query(
    "plan1_stream_deduplicate",
    clicks_sql("SELECT event_id, epoch_us(ts) AS ts_us FROM clicks"),
)
def stream_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every event arrives twice; the copy is dropped inside the watermark."""
    events = clicks_stream(spark, root).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return run_append(spark, unique.select("event_id", "ts"), "dedup").select(
        "event_id", micros("ts").alias("ts_us")
    )


# ---------------------------------------------------------------- stored search index

# Every tenth event is indexed again with another URL.
_MOVED = """moved AS (SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN '/moved/42' ELSE url END AS url) FROM clicks)"""
_MOVED_HITS = """SELECT event_id, ts, url FROM moved WHERE event_type = 'purchase' OR event_name = 'e3'
  OR regexp_matches(url, '(^|/)42$') OR k = 42 OR user_agent LIKE '%Firefox%'"""


def stored_index(spark: SparkSession, root: str) -> str:
    """The events indexed in four micro-batches, and a tenth of them once more."""
    base = ws.fresh_folder(spark, "search")
    sinks.start(clicks_stream(spark, root), f"{base}/cp", lambda rows, n: postings.index_batch(rows, f"{base}/index", n)).awaitTermination()
    again = clicks(spark, root).where(F.col("event_id").cast("long") % 10 == 0).withColumn("url", F.lit("/moved/42"))
    postings.index_batch(again, f"{base}/index", 1000)
    return f"{base}/index"


@query(
    "snk13_stored_index",
    clicks_sql(
        """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events, count(*) FILTER (url = '/moved/42') AS moved
        FROM moved GROUP BY ALL""",
        _MOVED,
    ),
)
def snk13_stored(spark: SparkSession, root: str) -> DataFrame:
    """Documents by month: an id indexed again stays one row, the newer one."""
    docs = postings.documents(spark, stored_index(spark, root), clicks(spark, root).schema)
    return docs.groupBy("month").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("url") == "/moved/42").alias("moved"))


@query("qry2_stored_search_hits", clicks_sql(f"SELECT event_id, epoch_us(ts) AS ts_us FROM ({_MOVED_HITS})", _MOVED))
def qry2_stored(spark: SparkSession, root: str) -> DataFrame:
    found = postings.hits(spark, stored_index(spark, root), "Purchase, e3 42 firefox")
    return found.select("event_id", micros("ts").alias("ts_us"))


@query("qry2_stored_search_total", clicks_sql(f"SELECT count(*) AS total FROM ({_MOVED_HITS})", _MOVED))
def qry2_stored_total(spark: SparkSession, root: str) -> DataFrame:
    """Counted in an index that was compacted."""
    index = stored_index(spark, root)
    postings.compact(spark, index, clicks(spark, root).schema)
    return postings.total(spark, index, "Purchase, e3 42 firefox")


@query(
    "top4_stored_search_page",
    clicks_sql(f"SELECT event_id, epoch_us(ts) AS ts_us, url FROM ({_MOVED_HITS}) ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10", _MOVED),
)
def top4_stored(spark: SparkSession, root: str) -> DataFrame:
    index = stored_index(spark, root)
    page = postings.page(spark, index, "Purchase, e3 42 firefox", clicks(spark, root).schema, size=20, start=10)
    return page.select("event_id", micros("ts").alias("ts_us"), "url")
