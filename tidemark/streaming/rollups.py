"""Rollups, panes and sessions as streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidemark import workspace as ws
from tidemark.operators.metrics import global_metrics, with_rate_change
from tidemark.operators.rollup import Rollup
from tidemark.operators.sessions import GAP, daily_session_metrics, stream_sessions
from tidemark.streaming.sinks import publish_batch, publish_staged, published, staged, start

METRICS_DELAY = "5 seconds"
SESSION_DELAY = "10 seconds"
_LAST, _MEMORY = "_last.json", "_memory"


def start_rollup(
    events: DataFrame,
    rollup: Rollup,
    table: str,
    checkpoint: str,
    delay: str = METRICS_DELAY,
    every: str | None = None,
) -> StreamingQuery:
    """Closed windows of a rollup, appended to `table`. A rollup that looks back over its own rows
    is given what it remembers of earlier batches, which travels with the newest of them."""
    partial = rollup.partial(events.withWatermark("ts", delay))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if published(spark, table, batch_id):
            return
        with staged(batch, table, batch_id) as partials:
            rows = rollup.finish(partials)
            if rollup.carry is None:
                publish_batch(rows, table, batch_id)
                return
            path = f"{table}/_staging/{batch_id}-{uuid.uuid4().hex}"
            earlier = _remembered(spark, table, batch_id, rows.schema)
            rollup.carry(rows, earlier).write.parquet(path)
            written = spark.read.schema(rows.schema).parquet(path)
            rollup.remember(written.unionByName(earlier)).write.parquet(f"{path}/{_MEMORY}")
            publish_staged(spark, path, table, batch_id)

    return start(partial, checkpoint, handle, every)


def _newest_before(spark: SparkSession, table: str, batch_id: int) -> str | None:
    numbers = [int(n.split("=")[1]) for n in ws.child_names(spark, table) if n.startswith("batch_id=")]
    earlier = [n for n in numbers if n < batch_id]
    return f"{table}/batch_id={max(earlier)}" if earlier else None


def _remembered(spark: SparkSession, table: str, batch_id: int, schema: StructType) -> DataFrame:
    """What the batch before has remembered; its folder's name keeps it out of the table."""
    before = _newest_before(spark, table, batch_id)
    return spark.read.schema(schema).parquet(f"{before}/{_MEMORY}") if before else spark.createDataFrame([], schema)


def start_global_metrics(
    events: DataFrame,
    table: str,
    checkpoint: str,
    size: str = "1 second",
    delay: str = METRICS_DELAY,
    every: str | None = None,
) -> StreamingQuery:
    """Global metrics with the change against the window before. The last window of a batch
    travels with the published batch, so the comparison survives a restart."""
    rollup = global_metrics(size)
    partial = rollup.partial(events.withWatermark("ts", delay))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if published(spark, table, batch_id):
            return
        last = _last_window(spark, table, batch_id)
        previous = None
        if last is not None:
            previous = spark.createDataFrame([(last["event_count"],)], "event_count long")
        path = f"{table}/_staging/{batch_id}-{uuid.uuid4().hex}"
        with staged(batch, table, batch_id) as partials:
            windows = rollup.finish(partials)
            with_rate_change(windows, previous).write.parquet(path)
            newest = windows.agg(F.max_by("event_count", "window_start")).head()[0]
        if newest is not None:
            last = {"event_count": newest}
        if last is not None:
            ws.write_json(spark, f"{path}/{_LAST}", last)
        publish_staged(spark, path, table, batch_id)

    return start(partial, checkpoint, handle, every)


def _last_window(spark: SparkSession, table: str, batch_id: int) -> dict | None:
    before = _newest_before(spark, table, batch_id)
    if before is None or not ws.exists(spark, f"{before}/{_LAST}"):
        return None
    return ws.read_json(spark, f"{before}/{_LAST}")


def start_append(
    closed: DataFrame, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append the closed rows of any streaming aggregate."""
    return start(closed, checkpoint, lambda b, i: publish_batch(b, table, i), every)


def sessions_stream(events: DataFrame, gap: str = GAP, delay: str = SESSION_DELAY) -> DataFrame:
    return stream_sessions(events.withWatermark("ts", delay), gap)


def daily_sessions_stream(events: DataFrame, gap: str = GAP, delay: str = SESSION_DELAY) -> DataFrame:
    """Sessions chained into a daily window, both closed by the same watermark."""
    return daily_session_metrics(sessions_stream(events, gap, delay), gap)


def per_partition_watermark(sources: list[DataFrame], delay: str) -> DataFrame:
    """One stream per log partition, each with its own watermark, in union: the query's
    watermark is the smallest of them, so a slow partition loses nothing to a fast one."""
    marked = [s.withWatermark("ts", delay) for s in sources]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s)
    return out


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has turned away in the batches the query still remembers."""
    return sum(
        int(op["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
