"""The fresh tier: a second, independent reader of the same log, seconds behind it.

A published batch carries the positions it reaches, and the next one goes on from there. A new or
lost checkpoint thus neither drops nor doubles rows: what comes again lies below the positions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import workspace as ws
from tidemark.functions.orders import event_time
from tidemark.schemas import ORDER_ROW
from tidemark.sources.wire import accepted, decode_orders
from tidemark.streaming.landing import in_order, not_yet_read
from tidemark.streaming.sinks import read_batches, start

_COLUMNS = [f.name for f in ORDER_ROW.fields]
_POSITIONS = "_positions.json"


def fresh_view(records: DataFrame) -> DataFrame:
    """Log records -> fresh rows: decode, drop what is rejected, milliseconds to timestamp."""
    good = accepted(decode_orders(records))
    return good.withColumn("event_time", event_time(F.col("event_time_ms"))).select(*_COLUMNS)


def positions(spark: SparkSession, table: str) -> tuple[int, dict[int, int], dict[int, int]]:
    """Number of the next batch, and the next and the first offset of each log partition."""
    found = [int(n.split("=")[1]) for n in ws.child_names(spark, table) if n.startswith("batch_id=")]
    if not found:
        return 0, {}, {}
    kept = ws.read_json(spark, f"{table}/batch_id={max(found)}/{_POSITIONS}")
    return max(found) + 1, *({int(p): o for p, o in kept[k].items()} for k in ("next", "first"))


def add_fresh(records: DataFrame, table: str, gapless: bool = True) -> bool:
    """Publish the records past the stored positions; False when there are none.

    Records of a partition must go on where the last batch ended; in a log with holes
    (`gapless=False`) they may go on later. Files are sorted by (event_time,
    event_id), so a time bound skips most row groups.
    """
    spark = records.sparkSession
    number, offsets, starts = positions(spark, table)
    new = records.where(not_yet_read(offsets, starts))
    reached = (
        new.groupBy("partition_id")
        .agg(
            F.min("offset_id").alias("first_offset"),
            (F.max("offset_id") + 1).alias("next_offset"),
            F.count_distinct("offset_id").alias("offsets"),
        )
        .collect()
    )
    if not reached:
        return False
    starts = in_order(reached, offsets, starts, gapless)
    path = f"{table}/_staging/{number}-{uuid.uuid4().hex}"
    fresh_view(new).sortWithinPartitions("event_time", "event_id").write.parquet(path)
    reached_to = offsets | {r.partition_id: r.next_offset for r in reached}
    ws.write_json(spark, f"{path}/{_POSITIONS}", {"next": reached_to, "first": starts})
    if not ws.publish(spark, path, f"{table}/batch_id={number}"):
        raise RuntimeError(f"batch {number} of {table} exists: another reader is running")
    return True


def start_fresh(
    log: DataFrame, table: str, checkpoint: str, every: str | None = None, gapless: bool = True
) -> StreamingQuery:
    return start(log, checkpoint, lambda records, _: add_fresh(records, table, gapless), every)


def fresh_rows(spark: SparkSession, table: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ORDER_ROW.fields])
    return read_batches(spark, table, schema).select(*_COLUMNS)
