"""Staged logs and slices are read and written by many tasks, with the same rows in the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.plans import streams
from tidemark.plans.registry import orders
from tidemark.sources.offsets import with_log_offsets


def parquet_files(spark, path):
    return [n for n in ws.child_names(spark, path) if n.startswith("part-")]


def test_a_segment_is_written_by_several_tasks(spark, folder, data):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        segments = streams.stage_log(spark, data, f"{folder}/staged")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(len(parquet_files(spark, s)) > 1 for s in segments)
    staged = spark.read.parquet(*segments).select("partition_id", "offset_id")
    want = with_log_offsets(orders(spark, data)).select("partition_id", "offset_id")
    assert staged.exceptAll(want).isEmpty() and want.exceptAll(staged).isEmpty()
    # Every segment goes on where the one before ends.
    ends = [
        {r.partition_id: (r.a, r.b) for r in spark.read.parquet(s).groupBy("partition_id").agg(F.min("offset_id").alias("a"), F.max("offset_id").alias("b")).collect()}
        for s in segments
    ]
    for before, after in zip(ends, ends[1:]):
        assert all(after[p][0] == before[p][1] + 1 for p in after)


def test_crash_comparison_numbers_the_log_once(spark, data, monkeypatch):
    numbered = []
    plain = streams.with_log_offsets
    monkeypatch.setattr(streams, "with_log_offsets", lambda events: numbered.append(1) or plain(events))
    out = streams.snk11(spark, data)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(numbered) == 2 and "row_number" not in plan  # the staged log, and what it is compared with
    assert {r["mode"]: (r.doubled, r.lost, r.exact) for r in out.collect()} == {
        "commit": (0, 0, True),
        "deduplicated": (0, 0, True),
        "naive_second": (0, 0, True),
        "naive_first": (1, 0, False),
    }


def test_a_slice_is_a_file_for_each_core(spark, folder, data):
    from tidemark.sources.tables import sliced_stream
    from tidemark.streaming import sinks

    seen = []

    def handle(batch, number):
        named = batch.select("ts", F.input_file_name().alias("file"))
        seen.append(tuple(named.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1)), F.count_distinct("file")).head()))

    sinks.start(sliced_stream(spark, data, "events", "ts", 4), f"{folder}/cp", handle).awaitTermination()
    assert len(seen) == 4 and sum(n for _, _, n, _ in seen) == spark.read.parquet(f"{data}/events.parquet").count()
    assert all(files > 1 for *_, files in seen)
    assert all(before[1] <= after[0] for before, after in zip(seen, seen[1:]))


def test_compaction_does_not_group_documents_again(spark, folder, monkeypatch):
    from test_events import click, clicks

    from tidemark.streaming import postings

    rows = clicks(spark, [click(1, 0), click(2, 60), click(3, 120)])
    postings.index_batch(rows, f"{folder}/index", 0)
    postings.index_batch(rows.where("event_id = '2'"), f"{folder}/index", 1)
    before = {tuple(r) for r in postings.documents(spark, f"{folder}/index", rows.schema).select("event_id", "version").collect()}
    monkeypatch.setattr(postings, "search_index", None)
    assert postings.compact(spark, f"{folder}/index", rows.schema) == 1
    after = {tuple(r) for r in postings.documents(spark, f"{folder}/index", rows.schema).select("event_id", "version").collect()}
    assert before == after and len(after) == 3
