"""Nothing is lost or doubled when checkpoints are, and what cannot be placed is refused."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_events import click, clicks
from test_landing import W, line, records

from tidemark.operators import analytics, metrics, quality
from tidemark.plans import streams
from tidemark.sources.wire import log_file_stream
from tidemark.streaming import fresh, landing, rollups, sinks


def log_of(spark, path, rows):
    records(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_fresh_tier_with_a_new_checkpoint(spark, folder):
    log, table = f"{folder}/log", f"{folder}/fresh"
    log_of(spark, log, [(0, i, line(i, 1_000 + i)) for i in range(5)])
    fresh.start_fresh(log_file_stream(spark, log), table, f"{folder}/cp-1").awaitTermination()
    log_of(spark, log, [(0, i, line(i, 1_000 + i)) for i in range(5, 9)])
    fresh.start_fresh(log_file_stream(spark, log), table, f"{folder}/cp-2").awaitTermination()
    assert fresh.fresh_rows(spark, table).count() == 9
    assert fresh.fresh_rows(spark, table).select("event_id").distinct().count() == 9
    assert not fresh.add_fresh(records(spark, [(0, 3, line(3, 1_003))]), table)
    with pytest.raises(ValueError, match="jumps"):
        fresh.add_fresh(records(spark, [(0, 11, line(11, 1_011))]), table)


def test_offsets_out_of_order_are_refused(spark, folder):
    table = f"{folder}/lake"
    with pytest.raises(ValueError, match="missing"):
        landing.land_batch(records(spark, [(0, i, line(i, 1_000 + i)) for i in (0, 1, 3)]), table, 1, W)
    assert landing.last_commit(spark, table).seq == 0


def test_holes_are_allowed_but_late_offsets_are_not(spark, folder):
    table = f"{folder}/lake"
    late = [(0, i, line(i, 1_000 + i)) for i in range(5, 9)]
    assert landing.land_batch(records(spark, late), table, 1, W, gapless=False).batch_count == 4
    assert landing.land_batch(records(spark, late), table, 1, W, gapless=False) is None
    assert landing.land_batch(records(spark, [(0, 20, line(20, 1_020))]), table, 1, W, gapless=False).batch_count == 1
    with pytest.raises(ValueError, match="below its start"):
        landing.land_batch(records(spark, [(0, i, line(i, 1_000 + i)) for i in range(5)]), table, 1, W, gapless=False)
    with pytest.raises(ValueError, match="comes after later ones"):
        landing.land_batch(records(spark, [(0, i, line(i, 1_000 + i)) for i in (12, 21)]), table, 1, W, gapless=False)


def test_a_log_may_start_anywhere(spark, folder):
    table, tier = f"{folder}/lake", f"{folder}/fresh"
    rows = [(0, i, line(i, 1_000 + i)) for i in range(100, 105)]
    assert landing.land_batch(records(spark, rows), table, 1, W).starts == {0: 100}
    assert fresh.add_fresh(records(spark, rows), tier) and not fresh.add_fresh(records(spark, rows), tier)
    early = records(spark, [(0, 99, line(99, 1_000))])
    for refused in (lambda: landing.land_batch(early, table, 1, W), lambda: fresh.add_fresh(early, tier)):
        with pytest.raises(ValueError, match="below its start"):
            refused()
    more = records(spark, [(0, 105, line(105, 1_200)), (1, 7, line(7, 1_300))])
    assert landing.land_batch(more, table, 1, W).starts == {0: 100, 1: 7} and fresh.add_fresh(more, tier)
    hole = records(spark, [(0, 110, line(110, 1_400))])
    with pytest.raises(ValueError, match="jumps"):
        fresh.add_fresh(hole, tier)
    assert fresh.add_fresh(hole, tier, gapless=False)
    assert landing.lake_rows(spark, table).count() == 7 and fresh.fresh_rows(spark, tier).count() == 8


def test_idle_partition_is_left_out_and_comes_back(spark, folder):
    table = f"{folder}/lake"

    def land(now, *rows, **options):
        options = {"late_aside": True, "idle_ms": 100} | options
        return landing.land_batch(records(spark, list(rows)), table, 3, W, now_ms=now, **options)

    assert land(0, (0, 0, line(0, 10_000)), (1, 0, line(1, 20_000))).watermark_ms == 0  # partition 2 is awaited
    held = land(90, (0, 1, line(2, 30_000)))
    assert (held.watermark_ms, held.idle) == (0, [])
    gone = land(150, (0, 2, line(3, 40_000)))  # 1 and 2 have been silent for too long
    assert (gone.watermark_ms, gone.idle) == (39_000, [1])
    back = land(200, (1, 1, line(4, 21_000)), (1, 2, line(5, 39_500)), (2, 0, line(6, 50_000)))
    assert (back.watermark_ms, back.idle, back.late_count) == (39_000, [], 1)
    assert land(210, (0, 3, line(7, 60_000)), (1, 3, line(8, 60_000))).watermark_ms == 49_000
    assert [r.event_id for r in landing.late_rows(spark, table).collect()] == ["e4"]
    assert landing.lake_rows(spark, table).count() == 8

    before = landing.last_commit(spark, table)
    rolled = landing.roll_back(spark, table)
    assert (rolled.watermark_ms, rolled.rolled_back_from_ms, rolled.offsets) == (21_000, 49_000, before.offsets)
    assert landing.lake_rows(spark, table).count() == 9 and landing.late_rows(spark, table).count() == 0
    assert landing.lake_rows(spark, table, before).count() == 8  # older commits stay as they were
    with pytest.raises(ValueError, match="rolled back only"):
        landing.roll_back(spark, table, 50_000)
    again = land(220, (0, 4, line(9, 20_000)))
    assert again.watermark_ms == 49_000 and again.late_count == 1 and again.adopted_seq == before.seq
    assert landing.lake_rows(spark, table).count() == 9 and landing.late_rows(spark, table).count() == 1


def test_a_backlog_lands_one_file_at_a_time(spark, folder, data):
    base = streams.backlog(spark, data, 22)
    landing.start_landing(
        log_file_stream(spark, f"{base}/log", max_files=1), f"{base}/lake", f"{base}/cp", 4, W
    ).awaitTermination()
    commit = landing.last_commit(spark, f"{base}/lake")
    assert commit.seq == 22
    lines = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/log").count()
    assert landing.read_table(spark, f"{base}/lake").count() == lines


@pytest.mark.parametrize("kind", ["rollup", "append", "hot"])
def test_batch_numbers_of_another_checkpoint_are_refused(spark, folder, kind):
    path, table = f"{folder}/in", f"{folder}/out"
    day = 86_400
    clicks(spark, [click(1, 0), click(2, 400 * day)]).coalesce(1).write.mode("append").parquet(path)
    source = lambda: spark.readStream.schema(clicks(spark, []).schema).parquet(path)

    def run(checkpoint):
        if kind == "rollup":
            return rollups.start_rollup(source(), metrics.event_type_metrics("1 hour"), table, checkpoint)
        if kind == "append":
            return rollups.start_append(source(), table, checkpoint)
        sink = sinks.hot_sink(table, "session_summary")
        rows = source().withColumn("end_time", F.col("ts"))
        return sinks.start(rows, checkpoint, sink)

    run(f"{folder}/cp-1").awaitTermination()
    before = sinks.read_batches(spark, table).count()
    run(f"{folder}/cp-1").awaitTermination()
    assert sinks.read_batches(spark, table).count() == before
    with pytest.raises(StreamingQueryException):
        run(f"{folder}/cp-2").awaitTermination()
    assert sinks.read_batches(spark, table).count() == before


def test_rows_without_a_flag_or_version_stay(spark, folder):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    sinks.split_sink(f"{folder}/main", f"{folder}/fallback", F.col("ok"))(rows, 0)
    ids = {n: {r.id for r in spark.read.parquet(f"{folder}/{n}/batch_id=0").collect()} for n in ("main", "fallback")}
    assert ids == {"main": {1}, "fallback": {2, 3}}
    versions = spark.createDataFrame([("a", None), ("b", None), ("b", 1), ("b", 2)], "k string, v int")
    assert {(r.k, r.v) for r in sinks.newest_per_key(versions, ["k"], "v").collect()} == {("a", None), ("b", 2)}
    arrivals = spark.createDataFrame([(1, 5), (9, 5), (None, 5), (1, None)], "event_time_ms long, t_at_arrival_ms long")
    kept, late = quality.split_late(arrivals)
    assert (kept.count(), late.count()) == (3, 1)


def test_session_over_midnight_is_one_journey(spark, folder):
    night = 86_400 - 60
    rows = [click(1, night, session="s"), click(2, night + 120, session="s"), click(3, 400 * 86_400, session=None)]
    path = f"{folder}/in"
    for r in rows:
        clicks(spark, [r]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rollups.start_rollup(stream, analytics.user_journeys(), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = sinks.read_batches(spark, f"{folder}/out").drop("batch_id")
    want = analytics.user_journeys()(clicks(spark, rows))
    assert want.count() == 1
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_trailing_mean_goes_on_over_micro_batches(spark, folder):
    rows, number = [], 0
    for day in range(12):
        for _ in range(day + 2):
            rows.append(click(number, day * 86_400 + number, country="US"))
            number += 1
    rows.append(click(99_999, 400 * 86_400, country=None))
    path = f"{folder}/in"
    for i in range(0, len(rows), 9):
        clicks(spark, rows[i : i + 9]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rollups.start_rollup(stream, analytics.daily_cohorts(), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = sinks.read_batches(spark, f"{folder}/out")
    want = analytics.daily_cohorts()(clicks(spark, rows))
    assert got.select("batch_id").distinct().count() > 3
    key = lambda df: sorted((r.window_start, round(r.seven_day_avg_events, 9)) for r in df.collect())
    assert key(got) == key(want) and isinstance(key(got)[0][0], dt.datetime)
