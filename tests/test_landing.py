"""Landing, the fresh tier and the seam against an independent truth, with crashes."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.operators import quality, seam
from tidemark.plans import streams
from tidemark.plans.orders import timed
from tidemark.plans.registry import orders
from tidemark.schemas import LOG_RECORD
from tidemark.sources.wire import decode_orders, log_file_stream, quarantine, starting_offsets
from tidemark.streaming import fresh, landing, sinks

W = 1000


def line(i, ms, kind="order_created", amount="10.00", order=None):
    return (
        f'{{"event_id":"e{i}","order_id":"o{order if order is not None else i}","event_type":"{kind}",'
        f'"amount":"{amount}","user_id":1,"event_time_ms":{ms}}}'
    )


def records(spark, rows):
    return spark.createDataFrame(rows, LOG_RECORD)


def test_commit_carries_offsets_watermark_and_counts(spark, folder):
    table = f"{folder}/lake"
    landing.create_table(spark, table)
    assert landing.last_commit(spark, table) == landing.Commit()
    assert landing.lake_rows(spark, table).count() == 0

    first = landing.land_batch(records(spark, [(0, 0, line(0, 5_000)), (0, 1, line(1, 4_500))]), table, 2, W)
    assert (first.seq, first.watermark_ms, first.offsets) == (1, 0, {0: 2})  # partition 1 is unheard
    second = landing.land_batch(records(spark, [(1, 0, line(2, 9_000))]), table, 2, W)
    assert (second.seq, second.watermark_ms) == (2, 4_000)
    assert second.offsets == {0: 2, 1: 1} and second.max_event_time_ms == {0: 5_000, 1: 9_000}
    assert landing.last_commit(spark, table) == second
    assert landing.resume_state(spark, table).head().seq == 2
    # The first commit stays readable as it was.
    assert landing.lake_rows(spark, table, first).count() == 2
    assert landing.lake_rows(spark, table).count() == 3


def test_repeated_records_add_nothing(spark, folder):
    table = f"{folder}/lake"
    batch = records(spark, [(0, i, line(i, 1_000 + i)) for i in range(5)])
    assert landing.land_batch(batch, table, 1, W).batch_count == 5
    assert landing.land_batch(batch, table, 1, W) is None
    longer = records(spark, [(0, i, line(i, 1_000 + i)) for i in range(8)])
    assert landing.land_batch(longer, table, 1, W).batch_count == 3
    assert landing.lake_rows(spark, table).count() == 8


def test_broken_lines_are_kept_aside_and_counted_as_read(spark, folder):
    table = f"{folder}/lake"
    rows = [
        (0, 0, line(0, 1_000)),
        (0, 1, '{"event_id":"e1","ord'),
        (0, 2, line(2, 1_002, kind="order_refunded")),
        (0, 3, line(3, 1_003, amount="1.005")),
        (0, 4, '{"event_id":"e4"}'),
        (0, 5, "   "),
    ]
    commit = landing.land_batch(records(spark, rows), table, 1, W)
    assert commit.offsets == {0: 6} and commit.batch_count == 1
    bad = {r.offset_id: (r.reject_reason, r.value) for r in landing.rejected_lines(spark, table).collect()}
    assert {k: v[0] for k, v in bad.items()} == {
        1: "malformed_json",
        2: "unknown_event_type",
        3: "bad_amount",
        4: "missing_field",
        5: bad[5][0],
    }
    assert bad[1][1] == rows[1][2]
    assert landing.lake_rows(spark, table).agg(F.sum("amount")).head()[0] == Decimal("10.00")


def test_a_hole_in_the_log_is_noticed(spark, folder):
    table = f"{folder}/lake"
    landing.land_batch(records(spark, [(0, 0, line(0, 1_000))]), table, 1, W, gapless=True)
    with pytest.raises(ValueError, match="jumps"):
        landing.land_batch(records(spark, [(0, 2, line(2, 1_002))]), table, 1, W, gapless=True)


def test_second_writer_cannot_take_a_commit(spark, folder):
    table = f"{folder}/lake"

    def other_first(s, staged, target):
        landing.land_batch(records(s, [(0, 0, line(0, 1_000))]), table, 1, W)
        return ws.publish(s, staged, target)

    with pytest.raises(RuntimeError, match="another landing job"):
        landing.land_batch(records(spark, [(0, 0, line(0, 1_000))]), table, 1, W, publish=other_first)
    assert landing.lake_rows(spark, table).count() == 1


def test_no_commit_means_all_fresh(spark, folder):
    table = f"{folder}/lake"
    landing.create_table(spark, table)
    events = spark.createDataFrame(
        [("order_created", Decimal("5.00"), 1_000)], "event_type string, amount decimal(18,2), ms long"
    ).withColumn("event_time", F.timestamp_millis("ms"))
    t = landing.last_commit(spark, table).watermark_ms
    row = seam.seam_totals(landing.lake_rows_below(spark, table, t), events, t).head()
    assert (row.watermark_t_ms, row.lake_count, row.ch_count, row.gmv) == (0, 0, 1, Decimal("5.00"))


def test_seam_equals_truth_for_any_t(spark, data):
    events = timed(spark, data).cache()
    truth = seam.ground_truth(orders(spark, data), 0).head()
    lo, hi = events.agg(F.min("event_time_ms"), F.max("event_time_ms")).head()
    rng = random.Random(5)
    for t in [0, lo, hi, hi + 1, *[rng.randint(lo, hi) for _ in range(4)]]:
        row = seam.seam_totals(events, events, t).head()
        assert (row["count"], row.gmv) == (truth["count"], truth.gmv)
    events.unpersist()


def test_landing_and_fresh_tier_agree_with_the_source(spark, data):
    lake, fresh_table = streams.land(spark, data)
    commit = landing.last_commit(spark, lake)
    assert commit.seq > 1 and commit.watermark_ms > 0
    source = orders(spark, data)
    rejected = quarantine(decode_orders(streams.wire_lines(source))).count()
    rows = landing.lake_rows(spark, lake)
    stats = seam.duplicate_stats(rows).head()
    assert stats.total == stats.distinct_ids == source.count() - rejected
    # The set of ids below T is the same in the lake and in the fresh tier, and it is not small.
    below = landing.lake_rows_below(spark, lake, commit.watermark_ms).select("event_id")
    fresh_below = fresh.fresh_rows(spark, fresh_table).where(F.unix_millis("event_time") < commit.watermark_ms)
    assert below.count() > 1000
    assert quality.set_difference(fresh_below, below).count() == 0


def test_lost_stream_checkpoint_neither_doubles_nor_loses(spark, data, folder):
    log, table = f"{folder}/log", f"{folder}/lake"
    first, *rest = streams.stage_log(spark, data, f"{folder}/staged")
    ws.publish(spark, first, f"{log}/0")
    landing.start_landing(log_file_stream(spark, log), table, f"{folder}/cp", 4, W).awaitTermination()
    before = landing.last_commit(spark, table)
    for i, segment in enumerate(rest, 1):
        ws.publish(spark, segment, f"{log}/{i}")
    # The next run has no checkpoint and reads the log from its beginning.
    landing.start_landing(
        log_file_stream(spark, log), table, f"{folder}/cp-new", 4, W
    ).awaitTermination()
    after = landing.last_commit(spark, table)
    rows = landing.read_table(spark, table)
    assert rows.count() == rows.select("partition_id", "offset_id").distinct().count() == orders(spark, data).count()
    assert after.watermark_ms > before.watermark_ms > 0


def test_crashes_on_both_sides_of_the_commit(spark, data):
    lake, first, second = streams.land_with_crashes(spark, data)
    n = orders(spark, data).count()
    rows = landing.read_table(spark, lake)
    assert rows.count() == rows.select("partition_id", "offset_id").distinct().count() == n
    # The same crashes make two plain writes disagree.
    assert spark.read.parquet(first).count() > n
    assert spark.read.parquet(second).count() == n


def test_published_batch_is_not_published_again(spark, folder):
    df = spark.range(5)
    assert sinks.publish_batch(df, f"{folder}/t", 0)
    assert not sinks.publish_batch(df, f"{folder}/t", 0)
    assert sinks.read_batches(spark, f"{folder}/t").count() == 5


def test_drop_and_recreate(spark, folder):
    table = f"{folder}/lake"
    landing.land_batch(records(spark, [(0, 0, line(0, 1_000))]), table, 1, W)
    landing.create_table(spark, table, drop_existing=True)
    assert landing.last_commit(spark, table).seq == 0


def test_a_restart_names_every_partition(spark):
    assert starting_offsets("orders", {}) == "earliest"
    assert starting_offsets("orders", {0: 5, 2: 7}, 3) == '{"orders": {"0": 5, "1": -2, "2": 7}}'
