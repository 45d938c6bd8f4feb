"""Sinks for micro-batches. Every write goes to <table>/batch_id=N, published by one rename,
so a repeated micro-batch finds its folder already there and adds nothing.

Batch numbers start again with a new checkpoint. Each published batch therefore names the stream
it came from, and a number that another stream has used is an error, never a skipped batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import workspace as ws
from tidemark.operators.search import search_index
from tidemark.operators.tiers import alive, latest_values, warm_rows

# Key columns of the nine hot metric tables; the newest row per key is the current one.
HOT_TABLES = {
    "global_metrics": ([], "window_start"),
    "event_type_metrics": (["event_type"], "window_start"),
    "country_metrics": (["country"], "window_start"),
    "active_users": ([], "window_start"),
    "page_view_metrics": ([], "window_start"),
    "error_metrics": ([], "window_start"),
    "session_summary": (["session_id"], "end_time"),
    "active_sessions": (["user_id"], "last_activity"),
    "user_journey": (["user_id", "session_id"], "last_updated"),
}

_STREAM = "_stream.json"


class BatchId(int):
    """The number of a micro-batch, and the id of the stream (its checkpoint) that counts it."""

    stream: str = ""

    @classmethod
    def of(cls, number: int, stream: str) -> BatchId:
        made = cls(number)
        made.stream = stream
        return made


def published(spark: SparkSession, table: str, batch_id: int) -> bool:
    """Whether this stream has published the batch; another stream's batch of that number is an error."""
    target = f"{table}/batch_id={batch_id}"
    if not ws.exists(spark, target):
        return False
    stream = getattr(batch_id, "stream", "")
    there = ws.read_json(spark, f"{target}/{_STREAM}")["stream"] if ws.exists(spark, f"{target}/{_STREAM}") else ""
    if there != stream:
        raise RuntimeError(f"batch {batch_id} of {table} was published under another checkpoint")
    return True


def publish_staged(spark: SparkSession, staged: str, table: str, batch_id: int) -> bool:
    """Publish a written folder as the batch."""
    ws.write_json(spark, f"{staged}/{_STREAM}", {"stream": getattr(batch_id, "stream", "")})
    return ws.publish(spark, staged, f"{table}/batch_id={batch_id}") or not published(spark, table, batch_id)


def publish_batch(df: DataFrame, table: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> bool:
    """Write a micro-batch once; False when this stream had published it before."""
    spark = df.sparkSession
    if published(spark, table, batch_id):
        return False
    staged = f"{table}/_staging/{batch_id}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(staged)
    return publish_staged(spark, staged, table, batch_id)


@contextmanager
def staged(batch: DataFrame, table: str, batch_id: int) -> Iterator[DataFrame]:
    """The micro-batch as a written table, so that using it twice does not run the stateful
    plan twice and a lost executor does not either. It goes when the block is done, or fails."""
    spark = batch.sparkSession
    path = f"{table}/_staging/partial-{batch_id}-{uuid.uuid4().hex}"
    try:
        batch.write.parquet(path)
        yield spark.read.schema(batch.schema).parquet(path)
    finally:
        ws.drop_folder(spark, path)


def read_batches(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All published micro-batches, with their batch_id."""
    names = [n for n in ws.child_names(spark, table) if n.startswith("batch_id=")]
    if not names:
        if schema is None:
            raise FileNotFoundError(f"nothing published in {table}")
        return spark.createDataFrame([], schema.add("batch_id", "long"))
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return reader.parquet(table)


def start(
    df: DataFrame,
    checkpoint: str,
    handle: Callable[[DataFrame, int], object],
    every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Run `handle` on every micro-batch; without `every` until the source is read."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def numbered(batch: DataFrame, batch_id: int) -> None:
        stream = ws.read_json(batch.sparkSession, f"{checkpoint}/metadata")["id"]
        handle(batch, BatchId.of(batch_id, stream))

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(numbered)
        .trigger(**trigger)
        .start()
    )


def rewrite_by_day(rows: DataFrame, path: str) -> None:
    """A copy of a table in day folders, under a new path. Small days share a task, a large day
    is cut into several."""
    rows.hint("rebalance", "date_partition").write.partitionBy("date_partition").parquet(path)


def newest_per_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of every key; rows of a key combine map-side. A row without version is the
    oldest, and the one of a key that has no other."""
    whole = F.struct(*rows.columns)
    order = F.struct(F.col(version).isNotNull(), F.col(version))
    return rows.groupBy(*keys).agg(F.max_by(whole, order).alias("_r")).where("_r IS NOT NULL").select("_r.*")


def hot_table(name: str, every: int = 16):
    """A hot table as a folded view: the newest row of every key."""
    from tidemark.streaming.folding import Folded

    keys, version = HOT_TABLES[name]
    return Folded(lambda rows: newest_per_key(rows, keys, version), every)


def hot_sink(table: str, name: str, every: int = 16) -> Callable[[DataFrame, int], object]:
    """Keep the newest row per key of a hot table: a batch adds at most one row per key, and every
    `every` batches are folded into a base."""
    return lambda batch, batch_id: hot_table(name, every).add(batch, table, batch_id)


def hot_view(spark: SparkSession, table: str, name: str) -> DataFrame:
    """The newest row of every key, from the base and the batches after it."""
    return hot_table(name).rows(spark, table)


def split_sink(main: str, fallback: str, ok: Column) -> Callable[[DataFrame, int], object]:
    """Rows whose publishing failed, or of which nobody knows, go to the fallback table, row by row."""
    sent = F.coalesce(ok, F.lit(False))

    def handle(batch: DataFrame, batch_id: int) -> None:
        with staged(batch, main, batch_id) as rows:
            publish_batch(rows.where(sent), main, batch_id)
            publish_batch(rows.where(~sent), fallback, batch_id)

    return handle


def hot_values(every: int = 16):
    """Stored values as a folded view: the last write of every key."""
    from tidemark.streaming.folding import Folded

    return Folded(lambda rows: newest_per_key(rows, ["event_id"], "put_time"), every)


def counters(every: int = 16):
    """Counters as a folded view: a minute may receive rows in several batches."""
    from tidemark.streaming.folding import Folded

    return Folded(lambda rows: rows.groupBy("minute", "user_id").agg(F.sum("events").alias("events")), every)


def stored_values(spark: SparkSession, root: str, as_of: Column | None = None) -> DataFrame:
    """The value of every key, as far as it has not expired by `as_of`."""
    values = hot_values().rows(spark, f"{root}/hot")
    return values if as_of is None else alive(values, as_of)


def tiered_store(root: str, ttl_seconds: int = 3600, every: int = 16) -> Callable[[DataFrame, int], object]:
    """Every event into the warm table, the search index, the hot values and the counters.

    Four tables, each published once per batch; a crash between them is repaired by the
    repeated batch, which skips the tables it has already reached.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with staged(batch, root, batch_id) as rows:
            publish_batch(warm_rows(rows), f"{root}/warm", batch_id, ("date_partition",))
            publish_batch(search_index(rows), f"{root}/search", batch_id, ("month",))
            value = F.to_json(F.struct("event_id", "user_id", "event_type", "url"))
            hot = latest_values(rows, "event_id", value, "ts", F.lit(ttl_seconds))
            hot_values(every).add(hot, f"{root}/hot", batch_id)
            minute = F.date_trunc("minute", "ts").alias("minute")
            counts = rows.groupBy(minute, "user_id").agg(F.count(F.lit(1)).alias("events"))
            counters(every).add(counts, f"{root}/counters", batch_id)

    return handle


def stored_counters(spark: SparkSession, root: str, per_user: bool = False) -> DataFrame:
    """Counters over all batches."""
    rows = counters().rows(spark, f"{root}/counters")
    total = F.sum("events").alias("events_count")
    start = F.col("minute").alias("window_start")
    if not per_user:
        return rows.groupBy(start).agg(total)
    return rows.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0)).groupBy(start, "user_id").agg(total)


def stored_search_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per event id over all batches: indexing an id again replaces it."""
    rows = read_batches(spark, f"{root}/search")
    return newest_per_key(rows, ["event_id"], "batch_id").drop("batch_id")


def dual_write(first: str, second: str, fail_between: Callable[[int], None] | None = None):
    """Two writes in a row with nothing to tie them together and nothing to recognise a repeat.

    Kept to measure what it loses and doubles against land_batch; not for use.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(first)
        if fail_between is not None:
            fail_between(batch_id)
        batch.write.mode("append").parquet(second)

    return handle
