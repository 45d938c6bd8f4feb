"""Exactly-once landing of order events.

A commit is one folder, table/seq=N, holding the rows of a micro-batch, the lines that could
not be decoded, and the progress they stand for: next offset and largest event time of every
log partition, the safe watermark T, the row count. The folder is written under a staging name
and renamed once. Before the rename nothing of it is visible; after it everything is. A killed
job leaves at most an unreferenced staging folder.

Progress lives in the commit, so a restart needs nothing else: rows whose offset lies below
the committed next offset are skipped, whether they come back because a micro-batch is
repeated or because the stream's checkpoint was lost and the log is read from the start.
Skipping is only right if such rows have been landed. In a gapless log (the default) each batch
must go on exactly where the commit ends and hold every offset up to its last, so nothing below
can be missing; in a log with holes the skipped rows are looked up in the table. Otherwise the
batch is refused.

A log may start anywhere: the first offset seen of a partition is where it starts, and a row that later
turns up below that is refused, not skipped.

T waits for every partition. With `idle_ms`, a partition that has sent nothing for that long (by the
clock of the commits) is left out until it sends again; T never goes back then. What such a
partition brings may lie below T. With `late_aside` rows below the T of the commit before are written
to their own folder, `kind=late`, in the same commit, so that history below T does not change unseen.
`roll_back` is a commit without rows that moves T back and adopts the late rows so far into the
table: under the new T the fresh tier answers for what lies above it, and nothing is missing.

The rename must be atomic, as it is on HDFS-like file systems. On an object store without
atomic rename a table format's commit has to take its place.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import workspace as ws
from tidemark.functions.orders import below, event_time
from tidemark.operators.watermark import merge_progress, safe_watermark
from tidemark.schemas import ORDER_ROW
from tidemark.sources.wire import decode_orders

MANIFEST = "_commit.json"
DAY = "event_time_day"

# Rows and rejected lines share one layout; `kind` and the day are folders.
TABLE = T.StructType(
    [
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("offset_id", T.LongType()),
        *[T.StructField(f.name, f.dataType) for f in ORDER_ROW.fields],
        T.StructField("value", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField(DAY, T.DateType()),
    ]
)
_FILE_COLUMNS = [f.name for f in TABLE.fields if f.name not in ("seq", "kind", DAY)]


@dataclass
class Commit:
    """What a restart or a query needs to know about the table; the defaults mean 'no commit'."""

    seq: int = 0
    watermark_ms: int = 0
    lateness_ms: int = 0
    batch_count: int = 0
    offsets: dict[int, int] = field(default_factory=dict)
    max_event_time_ms: dict[int, int] = field(default_factory=dict)
    #: First offset of each partition, and when (by the commits' clock) each was last heard from.
    starts: dict[int, int] = field(default_factory=dict)
    heard_ms: dict[int, int] = field(default_factory=dict)
    opened_ms: int = 0
    idle: list[int] = field(default_factory=list)
    #: Late rows of this commit; late rows of commits up to `adopted_seq` count as rows of the table.
    late_count: int = 0
    adopted_seq: int = 0
    rolled_back_from_ms: int | None = None

    @classmethod
    def from_json(cls, d: dict) -> Commit:
        maps = ("offsets", "max_event_time_ms", "starts", "heard_ms")
        ints = {k: {int(p): int(v) for p, v in d.get(k, {}).items()} for k in maps}
        return cls(**{**d, **ints})


def create_table(spark: SparkSession, table: str, drop_existing: bool = False) -> None:
    """An empty day-partitioned table; optionally dropping what is there."""
    if drop_existing:
        ws.drop_folder(spark, table)
    if not ws.exists(spark, f"{table}/_staging"):
        ws._fs(spark, table).mkdirs(ws._path(spark, f"{table}/_staging"))


def last_commit(spark: SparkSession, table: str) -> Commit:
    """The newest commit: one folder listing and one small file."""
    found = [re.fullmatch(r"seq=(\d+)", name) for name in ws.child_names(spark, table)]
    newest = max((int(m.group(1)) for m in found if m), default=0)
    if newest == 0:
        return Commit()
    return Commit.from_json(ws.read_json(spark, f"{table}/seq={newest}/{MANIFEST}"))


def resume_state(spark: SparkSession, table: str) -> DataFrame:
    """The newest commit as one row."""
    c = last_commit(spark, table)
    schema = (
        "seq long, watermark_ms long, lateness_ms long, batch_count long, "
        "offsets map<int,long>, max_event_time_ms map<int,long>"
    )
    return spark.createDataFrame(
        [(c.seq, c.watermark_ms, c.lateness_ms, c.batch_count, c.offsets, c.max_event_time_ms)], schema
    )


def read_table(spark: SparkSession, table: str, commit: Commit | None = None) -> DataFrame:
    """All committed rows as of `commit` (the newest when not given), with seq, kind and day."""
    pinned = commit or last_commit(spark, table)
    if pinned.seq == 0:
        return spark.createDataFrame([], TABLE)
    return spark.read.schema(TABLE).parquet(table).where(F.col("seq") <= pinned.seq)


def lake_rows(spark: SparkSession, table: str, commit: Commit | None = None) -> DataFrame:
    """The rows of the table, late ones only where a roll-back has adopted them."""
    pinned = commit or last_commit(spark, table)
    adopted = (F.col("kind") == "late") & (F.col("seq") <= pinned.adopted_seq)
    rows = read_table(spark, table, pinned).where((F.col("kind") == "rows") | adopted)
    return rows.select("partition_id", "offset_id", *[f.name for f in ORDER_ROW.fields], DAY)


def lake_rows_below(spark: SparkSession, table: str, t_ms: int, commit: Commit | None = None) -> DataFrame:
    """Rows with event_time < T. The derived day bound prunes folders, the time bound files."""
    last_day = dt.datetime.fromtimestamp(t_ms / 1000, tz=dt.timezone.utc).date()
    rows = lake_rows(spark, table, commit)
    return rows.where(below(F.col("event_time"), t_ms) & (F.col(DAY) <= F.lit(last_day)))


def late_rows(spark: SparkSession, table: str, commit: Commit | None = None) -> DataFrame:
    """Rows written aside that no roll-back has adopted, with the commit they came in."""
    pinned = commit or last_commit(spark, table)
    late = read_table(spark, table, pinned).where((F.col("kind") == "late") & (F.col("seq") > pinned.adopted_seq))
    return late.select("partition_id", "offset_id", *[f.name for f in ORDER_ROW.fields], "seq")


def roll_back(spark: SparkSession, table: str, t_ms: int | None = None) -> Commit:
    """A commit that moves T back to `t_ms` (default: the oldest late row) and adopts the late rows so far."""
    state = last_commit(spark, table)
    if t_ms is None:
        oldest = late_rows(spark, table, state).agg(F.min(F.unix_millis("event_time"))).head()[0]
        t_ms = state.watermark_ms if oldest is None else min(oldest, state.watermark_ms)
    if t_ms > state.watermark_ms:
        raise ValueError(f"T can be rolled back only: {t_ms} is above {state.watermark_ms}")
    changed = {"seq": state.seq + 1, "watermark_ms": t_ms, "batch_count": 0, "late_count": 0}
    commit = replace(state, **changed, adopted_seq=state.seq, rolled_back_from_ms=state.watermark_ms)
    _publish(spark, table, f"{table}/_staging/{commit.seq}-{uuid.uuid4().hex}", commit, ws.publish)
    return commit


def _publish(spark: SparkSession, table: str, staged: str, commit: Commit, publish: Callable) -> None:
    ws.write_json(spark, f"{staged}/{MANIFEST}", vars(commit))
    if not publish(spark, staged, f"{table}/seq={commit.seq}"):
        raise RuntimeError(f"commit {commit.seq} of {table} exists: another landing job is running")


def rejected_lines(spark: SparkSession, table: str, commit: Commit | None = None) -> DataFrame:
    bad = read_table(spark, table, commit).where(F.col("kind") == "quarantine")
    return bad.select("partition_id", "offset_id", "value", "reject_reason")


def _known(values: dict[int, int]) -> Column:
    pairs = F.create_map(*[F.lit(x) for p, o in sorted(values.items()) for x in (p, o)])
    return F.try_element_at(pairs, F.col("partition_id"))


def not_yet_read(offsets: dict[int, int], starts: dict[int, int] | None = None) -> Column:
    """Rows at or past the next offset stored for their partition, and rows below where it started."""
    if not offsets:
        return F.lit(True)
    new = F.coalesce(F.col("offset_id") >= _known(offsets), F.lit(True))
    return new | F.coalesce(F.col("offset_id") < _known(starts), F.lit(False)) if starts else new


def in_order(positions: list, offsets: dict[int, int], starts: dict[int, int], gapless: bool = True) -> dict[int, int]:
    """Refuse a batch that holds a row below its partition's start or, of a gapless log, leaves out an offset.

    `positions`: partition_id, first_offset, next_offset and the number of distinct offsets. Returns the
    starts of all partitions: a partition starts at the first offset that is seen of it.
    """
    for p in positions:
        if p.first_offset < starts.get(p.partition_id, p.first_offset):
            raise ValueError(f"partition {p.partition_id}: offset {p.first_offset} lies below its start")
        if not gapless:
            continue
        expected = offsets.get(p.partition_id, p.first_offset)
        if p.first_offset != expected:
            raise ValueError(f"partition {p.partition_id}: log jumps from offset {expected} to {p.first_offset}")
        if p.next_offset - p.first_offset != p.offsets:
            raise ValueError(f"partition {p.partition_id}: offsets are missing below {p.next_offset}")
    return {p.partition_id: p.first_offset for p in positions} | starts


def skipped_are_landed(records: DataFrame, table: str, state: Commit) -> None:
    """Refuse a batch that holds a row below the committed offsets which is not in the table."""
    old = records.where(~not_yet_read(state.offsets, state.starts)).select("partition_id", "offset_id")
    if old.isEmpty():  # the usual batch: the table is not read
        return
    landed = read_table(records.sparkSession, table, state).select("partition_id", "offset_id")
    lost = old.join(landed, ["partition_id", "offset_id"], "left_anti").head()
    if lost is not None:
        raise ValueError(f"partition {lost.partition_id}: offset {lost.offset_id} comes after later ones")


def land_batch(
    records: DataFrame,
    table: str,
    partitions: int,
    lateness_ms: int,
    gapless: bool = True,
    publish: Callable[[SparkSession, str, str], bool] = ws.publish,
    late_aside: bool = False,
    idle_ms: int | None = None,
    now_ms: int | None = None,
) -> Commit | None:
    """Land one micro-batch of log records (partition_id, offset_id, value) as one commit.

    Returns the new commit, or None when every record had been landed before. Offsets of a
    partition must arrive in order, which is checked; `gapless=False` is for logs with holes.
    `now_ms` is the clock by which partitions become idle, by default the time of day.
    """
    spark = records.sparkSession
    state = last_commit(spark, table)
    if not gapless and state.offsets:
        skipped_are_landed(records, table, state)
    seq = state.seq + 1
    staged = f"{table}/_staging/{seq}-{uuid.uuid4().hex}"

    # One pass: decode, route good rows and rejected lines to their folders, write.
    decoded = decode_orders(records.where(not_yet_read(state.offsets, state.starts)))
    good = F.col("reject_reason").isNull()
    late = F.col("event_time_ms") < state.watermark_ms if late_aside else F.lit(False)
    (
        decoded.withColumns(
            {
                "event_time": event_time(F.col("event_time_ms")),
                "kind": F.when(good & late, "late").when(good, "rows").otherwise("quarantine"),
                "value": F.when(~good, F.col("value")),
            }
        )
        .withColumn(DAY, F.when(good, F.to_date("event_time")))
        .select(*_FILE_COLUMNS, "kind", DAY)
        .write.partitionBy("kind", DAY)
        .parquet(staged)
    )

    # Progress from the written files (three columns of them), one row per log partition.
    staged_schema = T.StructType([f for f in TABLE.fields if f.name != "seq"])
    written = spark.read.schema(staged_schema).parquet(staged)
    progress = (
        written.groupBy("partition_id")
        .agg(
            F.min("offset_id").alias("first_offset"),
            (F.max("offset_id") + 1).alias("next_offset"),
            F.max(F.when(F.col("kind") != "quarantine", F.unix_millis("event_time"))).alias("max_ms"),
            F.count_if(F.col("kind") != "quarantine").alias("n"),
            F.count_if(F.col("kind") == "late").alias("late"),
            F.count_distinct("offset_id").alias("offsets"),
        )
        .collect()
    )
    try:
        starts = in_order(progress, state.offsets, state.starts, gapless)
    except ValueError:
        ws.drop_folder(spark, staged)
        raise
    if not progress:
        ws.drop_folder(spark, staged)
        return None

    shape = "partition_id int, next_offset long, max_event_time_ms long"
    new = spark.createDataFrame([(p.partition_id, p.next_offset, p.max_ms) for p in progress], shape)
    known = [(p, o, state.max_event_time_ms.get(p)) for p, o in state.offsets.items()]
    merged = merge_progress(new, spark.createDataFrame(known, shape)).collect()
    now = int(time.time() * 1000) if now_ms is None else now_ms
    heard_ms = state.heard_ms | {p.partition_id: now for p in progress}
    opened = state.opened_ms if state.seq else now
    idle = sorted(p for p, at in heard_ms.items() if idle_ms is not None and now - at > idle_ms)
    never = partitions - len(merged) if idle_ms is not None and now - opened > idle_ms else 0
    heard = spark.createDataFrame([tuple(r) for r in merged if r.partition_id not in idle], shape)
    awaited = partitions - len(idle) - never
    commit = Commit(
        seq=seq,
        watermark_ms=safe_watermark(heard, lateness_ms, state.watermark_ms, awaited).head()[0],
        lateness_ms=lateness_ms,
        batch_count=sum(row.n for row in progress),
        offsets={r.partition_id: r.next_offset for r in merged},
        max_event_time_ms={r.partition_id: r.max_event_time_ms for r in merged if r.max_event_time_ms is not None},
        starts=starts,
        heard_ms=heard_ms,
        opened_ms=opened,
        idle=idle,
        late_count=sum(row.late for row in progress),
        adopted_seq=state.adopted_seq,
    )
    _publish(spark, table, staged, commit, publish)
    return commit


def start_landing(
    log: DataFrame,
    table: str,
    checkpoint: str,
    partitions: int,
    lateness_ms: int = 1000,
    every: str | None = None,
    gapless: bool = True,
    late_aside: bool = False,
    idle_ms: int | None = None,
) -> StreamingQuery:
    """Land a stream of log records. Without `every` (e.g. "2 seconds") the job reads what is
    there, in batches of the source's size limit, and ends."""
    create_table(log.sparkSession, table)
    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda records, _: land_batch(
            records, table, partitions, lateness_ms, gapless, late_aside=late_aside, idle_ms=idle_ms
        )
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
