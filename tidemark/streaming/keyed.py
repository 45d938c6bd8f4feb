"""Per-user state on a stream, kept in a table and brought forward with set operations.

State is one small row per key, in `buckets` parts by a hash of the user. A micro-batch joins only the
parts its users lie in, computes with the same operators as history does (operators.tracking), and
writes new versions of these parts; the others stay where an earlier batch put them. A part whose oldest
row the watermark has passed is read as well, so that silent users end on time. Output rows, new
state and the list of current parts are one folder, batch_id=N, published by one rename: a repeated
micro-batch changes nothing, and a crash in between leaves nothing behind that is read.

No step sees a user's rows one by one or in one task: events are combined inside (user, time bucket)
groups, and only one row per group is put in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import workspace as ws
from tidemark.functions.events import is_page_view
from tidemark.operators import tracking
from tidemark.operators.sessions import GAP, gap_micros
from tidemark.sources.offsets import bucket
from tidemark.streaming.sinks import publish_staged, published, staged, start

BUCKETS = 64
_CURRENT = "_current.json"

ACTIVE_STATE = (
    "user_id long, session_id string, last_activity timestamp, event_count long, countries array<string>, device_type string"
)
JOURNEY_STATE = (
    "user_id long, session_id string, views long, started_at timestamp, last_updated timestamp, "
    "pages array<struct<ts:timestamp,event_id:string,url:string,country:string>>"
)

#: Writes a part of the output under a name and gives it back as a table.
Write = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """A state schema, its time column, how long a row lives after that time, and one step.

    The step gets the rows of a micro-batch, the state of their parts, the watermark in microseconds and a
    writer for output, and returns the state that goes on.
    """

    state: str
    last: str
    lifetime_us: int
    step: Callable[[DataFrame, DataFrame, int, Write], DataFrame]


def _part(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, table: str) -> dict:
    """The newest batch's list of parts: {"newest_us": ..., "parts": {part: [batch, oldest_us]}}."""
    found = [int(n.split("=")[1]) for n in ws.child_names(spark, table) if n.startswith("batch_id=")]
    if not found:
        return {"newest_us": None, "parts": {}}
    return ws.read_json(spark, f"{table}/batch_id={max(found)}/{_CURRENT}")


def _state(spark: SparkSession, table: str, parts: dict, schema: str) -> DataFrame:
    paths = [f"{table}/batch_id={batch}/state/part={part}" for part, (batch, _) in parts.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def state_rows(spark: SparkSession, table: str, job: Job) -> DataFrame:
    """The state as the newest batch left it."""
    return _state(spark, table, _current(spark, table)["parts"], job.state)


def output(spark: SparkSession, table: str, name: str) -> DataFrame:
    """All output rows of one name, with their batch_id."""
    return spark.read.option("basePath", table).parquet(f"{table}/batch_id=*/{name}")


def batch_output(spark: SparkSession, table: str, name: str, batch_id: int) -> DataFrame:
    """The output rows of one name that one micro-batch has added."""
    return spark.read.parquet(f"{table}/batch_id={int(batch_id)}/{name}")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("_part", _part(buckets))


def _seen(batch: DataFrame) -> dict[str, int]:
    """The newest event time in every part of a batch, in microseconds; a row per part at most."""
    return {str(r._part): r.us for r in batch.groupBy("_part").agg(F.max(F.unix_micros("ts")).alias("us")).collect()}


def _bring(batch: DataFrame, seen: dict[str, int], table: str, batch_id: int, job: Job, delay: str, buckets: int) -> bool:
    """Publish output and state of a written micro-batch."""
    spark = batch.sparkSession
    now = _current(spark, table)
    newest = max([*seen.values()] + [now["newest_us"]] * (now["newest_us"] is not None), default=None)
    path = f"{table}/_staging/{batch_id}-{uuid.uuid4().hex}"
    parts = dict(now["parts"])
    if newest is not None:
        watermark = newest - gap_micros(delay)
        due = {k for k, (_, oldest) in parts.items() if oldest + job.lifetime_us < watermark}
        read = {k: v for k, v in parts.items() if k in due or k in seen}

        def write(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        kept = job.step(batch.drop("_part"), _state(spark, table, read, job.state), watermark, write)
        kept = kept.withColumn("part", _part(buckets))
        kept.repartition("part").write.partitionBy("part").parquet(f"{path}/state")
        written = spark.read.schema(kept.schema).parquet(f"{path}/state")
        parts = {k: v for k, v in parts.items() if k not in read}
        oldest = written.groupBy("part").agg(F.min(F.unix_micros(job.last)).alias("us")).collect()
        parts |= {str(r.part): [int(batch_id), r.us] for r in oldest}
    ws.write_json(spark, f"{path}/{_CURRENT}", {"newest_us": newest, "parts": parts})
    return publish_staged(spark, path, table, batch_id)


def advance(rows: DataFrame, table: str, batch_id: int, job: Job, delay: str = "10 seconds", buckets: int = BUCKETS) -> bool:
    """Bring the state of `table` forward by one micro-batch; False if it was published before."""
    if published(rows.sparkSession, table, batch_id):
        return False
    with staged(_dealt(rows, buckets), table, batch_id) as batch:
        return _bring(batch, _seen(batch), table, batch_id, job, delay, buckets)


def advance_all(
    rows: DataFrame, base: str, batch_id: int, jobs: dict[str, Job], then: Callable[[str], object], delay: str = "10 seconds", buckets: int = BUCKETS
) -> None:
    """Bring the tables `base`/name of several jobs forward by one micro-batch, which is written once.

    The jobs need nothing of each other and run side by side, so that the short stages of one leave no cores
    idle. `then` is called with a name when its table has the batch, also if it had it before.
    """
    spark = rows.sparkSession
    open_ = {name for name in jobs if not published(spark, f"{base}/{name}", batch_id)}
    with ExitStack() as stack:
        batch = stack.enter_context(staged(_dealt(rows, buckets), base, batch_id)) if open_ else None
        seen = _seen(batch) if open_ else {}

        def bring(name: str) -> None:
            if name in open_:
                _bring(batch, seen, f"{base}/{name}", batch_id, jobs[name], delay, buckets)
            then(name)

        with ThreadPoolExecutor(len(jobs)) as pool:
            # A thread of its own for each job, which carries the query's name and group to the jobs it starts.
            running = [pool.submit(inheritable_thread_target(spark)(bring), name) for name in jobs]
        for done in running:
            done.result()


def start_keyed(
    events: DataFrame, table: str, checkpoint: str, job: Job, delay: str = "10 seconds", every: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Run a job on every micro-batch of `events` (user_id, session_id, ts, event_id, ...)."""
    return start(events, checkpoint, lambda rows, number: advance(rows, table, number, job, delay, buckets), every)


def active_job(timeout: str = GAP, bucket_seconds: int = 900) -> Job:
    """Output `active`: a row for every event with the user's session as it then stands; `gone`: one for every
    user who was silent for longer than the timeout."""
    limit = gap_micros(timeout)

    def step(rows: DataFrame, state: DataFrame, watermark: int, write: Write) -> DataFrame:
        active = write("active", tracking.active_sessions(rows, timeout, bucket_seconds, carried=state))
        floor = state.select("user_id", F.col("last_activity").alias("_floor"))
        facts = F.struct("session_id", "event_count", "countries", "device_type")
        # A late event does not move the last activity back.
        at = F.greatest("last_activity", F.coalesce("_floor", "last_activity"))
        slots = (
            active.join(floor, "user_id", "left")
            .groupBy("user_id", bucket(F.unix_micros(at), limit).alias("slot"))
            .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max_by(facts, F.struct("last_activity", "event_id")).alias("facts"))
            .withColumn("fresh", F.lit(1))
        )
        before = state.select(
            "user_id",
            bucket(F.unix_micros("last_activity"), limit).alias("slot"),
            F.col("last_activity").alias("first"),
            F.col("last_activity").alias("last"),
            facts.alias("facts"),
            F.lit(0).alias("fresh"),
        )
        along = Window.partitionBy("user_id").orderBy("slot", "fresh")
        stretches = slots.unionByName(before).withColumn("next", F.lead("first").over(along))
        ends = F.unix_micros("last") + limit
        stretches = write(
            "stretches",
            stretches.withColumn(
                "over", F.when(F.col("next").isNull(), ends < watermark).otherwise(F.unix_micros("next") > ends)
            ).where(F.col("over") | F.col("next").isNull()),
        )
        write(
            "gone",
            stretches.where("over").select(
                "user_id", "facts.*", F.col("last").alias("last_activity"), F.timestamp_micros(ends).alias("timeout_at")
            ),
        )
        return stretches.where("NOT over").select(
            "user_id", "facts.session_id", F.col("last").alias("last_activity"), "facts.event_count", "facts.countries", "facts.device_type"
        )

    return Job(ACTIVE_STATE, "last_activity", limit, step)


def journey_job(newest: int = 50, idle: str = "1 day", bucket_seconds: int = 900) -> Job:
    """Output `views`: a row for every page view with its place in the journey. State: the newest pages of every journey.

    A journey nobody has added to for `idle` is forgotten.
    """
    key = ["user_id", "session_id"]

    def step(rows: DataFrame, state: DataFrame, watermark: int, write: Write) -> DataFrame:
        views = rows.where(is_page_view(F.col("event_type")) & (F.col("url") != ""))
        write("views", tracking.journey_updates(rows, newest, bucket_seconds, carried=state))
        page = F.struct("ts", "event_id", "url", "country").alias("page")
        pages = views.select(*key, page, F.lit(1).alias("new"))
        pages = pages.unionByName(state.select(*key, F.explode("pages").alias("page"), F.lit(0).alias("new")))
        order = Window.partitionBy(*key).orderBy(F.col("page.ts").desc(), F.col("page.event_id").desc())
        latest = pages.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= newest)
        latest = latest.groupBy(*key).agg(F.array_sort(F.collect_list("page")).alias("pages"))
        counts = views.groupBy(*key).agg(
            F.count(F.lit(1)).alias("views"), F.min("ts").alias("started_at"), F.max("ts").alias("last_updated")
        )
        counts = counts.unionByName(state.drop("pages")).groupBy(*key)
        counts = counts.agg(F.sum("views").alias("views"), F.min("started_at").alias("started_at"), F.max("last_updated").alias("last_updated"))
        a, b = counts.alias("a"), latest.alias("b")
        same = (F.col("a.user_id") == F.col("b.user_id")) & F.col("a.session_id").eqNullSafe(F.col("b.session_id"))
        kept = a.join(b, same).select("a.*", "b.pages")
        alive = F.unix_micros("last_updated") + gap_micros(idle) >= watermark
        return write("journeys", kept).where(alive)

    return Job(JOURNEY_STATE, "last_updated", gap_micros(idle), step)
