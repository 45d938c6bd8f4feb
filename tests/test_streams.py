"""Streams over several files equal the same operator over the table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_events import T0, click, clicks

from tidemark.operators import analytics, metrics, sessions, tracking
from tidemark.plans.catalog import REGISTRY
from tidemark.streaming import keyed, rollups, session_state, sinks

FAR = 400 * 86_400


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out, at = [], 0
    for i in range(240):
        at += rng.choice([1, 40, 300, 1900])
        out.append(
            click(
                i,
                at,
                user=rng.choice([1, 1, 1, 2, 3]),
                kind=rng.choice(["page_view", "page_view", "error", "purchase", "add_to_cart"]),
                url=f"/p{rng.randint(0, 14)}",
                country=rng.choice(["US", "DE", None]),
                session=f"s{at // 7200}",
                name=rng.choice([None, "e1", "e2"]),
            )
        )
    return out


@pytest.fixture
def stream(spark, folder, rows):
    """Four files in time order, a little disorder inside, and a far event that closes all windows."""
    path = f"{folder}/in"
    for i in range(4):
        part = rows[60 * i : 60 * (i + 1)]
        part = sorted(part, key=lambda r: r[0][::-1])
        if i == 3:
            part = [*part, click(99_999, FAR, user=9, kind="sentinel", country=None, url=None, session=None)]
        clicks(spark, part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df, drop=()):
    names = sorted(c for c in df.columns if c not in drop)
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


ROLLUPS = {
    "event_type": lambda: metrics.event_type_metrics("1 minute"),
    "country": lambda: metrics.country_metrics("1 hour"),
    "active": lambda: metrics.active_users("1 hour"),
    "views": lambda: metrics.page_view_metrics("6 hours", 3),
    "errors": lambda: metrics.error_metrics("6 hours"),
    "hourly": analytics.hourly_stats,
    "pages": lambda: analytics.hourly_page_views("6 hours", 2),
    "users": analytics.daily_user_metrics,
    "funnel": analytics.conversion_funnel,
    "counters": lambda: analytics.minute_counters(per_user=True),
}


@pytest.mark.parametrize("name", list(ROLLUPS))
def test_rollup_stream_equals_table(spark, folder, rows, stream, name):
    rollup = ROLLUPS[name]()
    rollups.start_rollup(stream, rollup, f"{folder}/out", f"{folder}/cp", "1 hour").awaitTermination()
    got = plain(sinks.read_batches(spark, f"{folder}/out"), ["batch_id"])
    want = plain(rollup(clicks(spark, rows)))
    assert got == want and len(want) > 0


def test_global_metrics_carry_the_last_window_over_batches(spark, folder, rows, stream):
    rollups.start_global_metrics(stream, f"{folder}/out", f"{folder}/cp", "1 hour", "1 hour").awaitTermination()
    out = sinks.read_batches(spark, f"{folder}/out")
    assert out.select("batch_id").distinct().count() > 1
    want = metrics.with_rate_change(metrics.global_metrics("1 hour")(clicks(spark, rows)))
    assert plain(out, ["batch_id"]) == plain(want)


def test_session_stream_equals_table(spark, folder, rows, stream):
    rollups.start_append(
        rollups.sessions_stream(stream, delay="1 hour"), f"{folder}/out", f"{folder}/cp"
    ).awaitTermination()
    out = sinks.read_batches(spark, f"{folder}/out")
    want = sessions.sessions(clicks(spark, rows))
    assert plain(out, ["batch_id", "session"]) == plain(want, ["unique_urls_count"])


def test_daily_sessions_stream_equals_table(spark, folder, rows, stream):
    rollups.start_append(
        rollups.daily_sessions_stream(stream, delay="1 hour"), f"{folder}/out", f"{folder}/cp"
    ).awaitTermination()
    want = sessions.daily_session_metrics(sessions.sessions(clicks(spark, rows)))
    assert plain(sinks.read_batches(spark, f"{folder}/out"), ["batch_id"]) == plain(want)


def test_panes_landed_by_a_stream_give_the_sliding_report(spark, folder, rows, stream):
    panes = analytics.geo_panes(stream.withWatermark("ts", "1 hour"))
    rollups.start_append(panes, f"{folder}/out", f"{folder}/cp").awaitTermination()
    landed = sinks.read_batches(spark, f"{folder}/out").drop("batch_id")
    got = analytics.geo_windows(landed, min_count=2)
    assert plain(got) == plain(analytics.geo_analysis(clicks(spark, rows), 2))


def run_keyed(spark, folder, stream, job, **options):
    keyed.start_keyed(stream, f"{folder}/out", f"{folder}/cp", job, **options).awaitTermination()
    return f"{folder}/out"


@pytest.mark.parametrize("bucket_seconds", [900, 60])
def test_active_sessions_stream_equals_history(spark, folder, rows, stream, bucket_seconds):
    table = run_keyed(spark, folder, stream, keyed.active_job(bucket_seconds=bucket_seconds), buckets=4)
    columns = ["event_id", "event_count", "countries", "session_id", "device_type"]
    out = keyed.output(spark, table, "active")
    assert out.select("batch_id").distinct().count() == 4
    active = out.where("user_id <> 9").select(columns)
    assert plain(active) == plain(tracking.active_sessions(clicks(spark, rows)).select(columns))
    gone = keyed.output(spark, table, "gone").select("user_id", "session_id", "timeout_at")
    want = tracking.session_timeouts(clicks(spark, rows)).select("user_id", "session_id", "timeout_at")
    assert plain(gone) == plain(want)
    (left,) = keyed.state_rows(spark, table, keyed.active_job()).collect()
    assert left.user_id == 9


def test_active_session_times_out_after_its_last_event(spark, folder):
    path = f"{folder}/in"
    for part in ([click(i, i * 1200) for i in range(3)], [click(9, FAR, user=9)]):
        clicks(spark, part).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = run_keyed(spark, folder, s, keyed.active_job())
    assert sorted(r.event_count for r in keyed.output(spark, table, "active").where("user_id = 1").collect()) == [1, 2, 3]
    (gone,) = keyed.output(spark, table, "gone").collect()
    assert gone.event_count == 3 and gone.timeout_at == T0 + dt.timedelta(seconds=2400 + 1800)


def test_only_touched_parts_are_written_and_batches_repeat(spark, folder):
    job, table = keyed.active_job(), f"{folder}/t"
    users = clicks(spark, [click(i, i, user=i, session="s") for i in range(40)])
    assert keyed.advance(users, table, 0, job, buckets=8)
    first = keyed._current(spark, table)
    assert len(first["parts"]) == 8
    again = clicks(spark, [click(100, 60, user=5, session="s", country="FR")])
    assert keyed.advance(again, table, 1, job, buckets=8) and not keyed.advance(again, table, 1, job, buckets=8)
    now = keyed._current(spark, table)
    assert sorted(b for b, _ in now["parts"].values()) == [0] * 7 + [1]
    state = {r.user_id: r for r in keyed.state_rows(spark, table, job).collect()}
    assert len(state) == 40 and state[5].event_count == 2 and state[5].countries[-1] == "FR"
    # A late event counts, but does not move the last activity back; a batch without rows changes nothing.
    late = clicks(spark, [click(101, 30, user=5, session="s")])
    assert keyed.advance(late, table, 2, job, buckets=8) and keyed.advance(late.limit(0), table, 3, job, buckets=8)
    state = {r.user_id: r for r in keyed.state_rows(spark, table, job).collect()}
    assert state[5].event_count == 3 and state[5].last_activity == T0 + dt.timedelta(seconds=60)
    # Time goes on: users of all parts end, without events of their own.
    assert keyed.advance(clicks(spark, [click(102, 5000, user=777)]), table, 4, job, buckets=8)
    assert keyed.output(spark, table, "gone").count() == 40
    assert [r.user_id for r in keyed.state_rows(spark, table, job).collect()] == [777]


def test_journey_stream_keeps_fifty_over_batches(spark, folder):
    path = f"{folder}/in"
    for part in range(3):
        piece = [click(i, i, url=f"/{i}") for i in range(20 * part, 20 * part + 20)]
        clicks(spark, piece).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = run_keyed(spark, folder, s, keyed.journey_job())
    out = keyed.output(spark, table, "views").orderBy("ts").collect()
    assert [r.page_count for r in out] == [min(i + 1, 50) for i in range(60)]
    assert [r.position for r in out] == list(range(60)) and out[-1].started_at == T0
    (journey,) = keyed.state_rows(spark, table, keyed.journey_job()).collect()
    assert [p.url for p in journey.pages] == [f"/{i}" for i in range(10, 60)] and journey.views == 60


def test_session_records_stream_equals_history(spark, folder, rows, stream):
    job = session_state.session_job()
    table = run_keyed(spark, folder, stream, job, buckets=4)
    want = sessions.sessions(clicks(spark, rows))
    got = keyed.output(spark, table, "sessions")
    assert plain(got.select(*want.columns)) == plain(want)
    assert got.select("batch_id").distinct().count() == 4
    pages = keyed.output(spark, table, "pages")
    starts = want.select("user_id", "start_time").collect()
    history = sessions.session_pages(clicks(spark, rows))
    assert plain(pages.select("user_id", "position", "page", "event_id")) == plain(history.select("user_id", "position", "page", "event_id"))
    assert {(r.user_id, r.opened) for r in pages.collect()} <= {(r.user_id, r.start_time) for r in starts}
    left = keyed.state_rows(spark, table, job).collect()
    assert [(r.user_id, r.page) for r in left if r.facts] == [(9, None)]


def test_idle_journeys_are_forgotten(spark, folder):
    job, table = keyed.journey_job(), f"{folder}/t"
    keyed.advance(clicks(spark, [click(1, 0, session=None), click(2, 10, session="a")]), table, 0, job)
    keyed.advance(clicks(spark, [click(3, FAR, user=9)]), table, 1, job)
    assert [r.user_id for r in keyed.state_rows(spark, table, job).collect()] == [9]
    assert keyed.output(spark, table, "journeys").count() >= 3


def test_slow_partition_is_not_overtaken(spark, folder):
    """One watermark per partition, the smallest counts: rows of the slow partition survive."""
    streams = []
    slow = [click(i, 60 * i, user=1) for i in range(10)]
    fast = [click(100 + i, 36_000 + 60 * i, user=2) for i in range(10)]
    for name, part in (("slow", slow), ("fast", fast)):
        for third in (part[:3], part[3:6], part[6:]):
            clicks(spark, third).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams.append(
            spark.readStream.schema(clicks(spark, []).schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(f"{folder}/{name}")
        )
    counts = {}
    for name, events in {
        "per_partition": rollups.per_partition_watermark(streams, "5 seconds"),
        "one_for_all": streams[0].unionByName(streams[1]).withWatermark("ts", "5 seconds"),
    }.items():
        agg = events.groupBy(F.window("ts", "1 minute"), "user_id").count()
        query = agg.writeStream.outputMode("update").format("memory").queryName(f"w_{name}")
        q = query.trigger(availableNow=True).start()
        q.awaitTermination()
        counts[name] = spark.table(f"w_{name}").where("user_id = 1").count()
    assert counts["per_partition"] == 10
    assert counts["one_for_all"] < 10


def test_hot_table_shows_only_the_newest(spark, folder):
    sink = sinks.hot_sink(f"{folder}/t", "event_type_metrics")
    first = [("a", T0, 1), ("a", T0 + dt.timedelta(hours=1), 2), ("b", T0, 3)]
    second = [("a", T0 + dt.timedelta(minutes=30), 9), ("b", T0 + dt.timedelta(hours=2), 4)]
    for i, part in enumerate((first, second, second)):
        sink(spark.createDataFrame(part, "event_type string, window_start timestamp, n int"), min(i, 1))
    got = {r.event_type: r.n for r in sinks.hot_view(spark, f"{folder}/t", "event_type_metrics").collect()}
    assert got == {"a": 2, "b": 4}


def test_hot_table_without_key_has_one_row(spark, folder):
    sink = sinks.hot_sink(f"{folder}/t", "global_metrics")
    schema = "window_start timestamp, n int"
    sink(spark.createDataFrame([(T0, 1)], schema), 0)
    sink(spark.createDataFrame([], schema), 1)
    assert [r.n for r in sinks.hot_view(spark, f"{folder}/t", "global_metrics").collect()] == [1]


def test_late_rows_are_counted(spark, folder):
    path = f"{folder}/in"
    for part in ([click(0, 36_000)], [click(1, 40_000)], [click(2, 0)], [click(3, 41_000)]):
        clicks(spark, part).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(clicks(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = s.withWatermark("ts", "5 seconds").groupBy(F.window("ts", "1 minute")).count()
    q = rollups.start_append(counts, f"{folder}/out", f"{folder}/cp")
    q.awaitTermination()
    assert rollups.late_rows(q) == 1


@pytest.mark.parametrize("name", list(sinks.HOT_TABLES))
def test_every_hot_table_keeps_one_row_per_key(spark, folder, name):
    keys, version = sinks.HOT_TABLES[name]
    moments = [T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(minutes=30)]
    sink = sinks.hot_sink(f"{folder}/t", name)
    for i, at in enumerate(moments):
        rows = [(*[k] * len(keys), at, i) for k in ("a", "b")]
        schema = ", ".join([*[f"{k} string" for k in keys], f"{version} timestamp", "n int"])
        sink(spark.createDataFrame(rows, schema), i)
    got = sinks.hot_view(spark, f"{folder}/t", name).collect()
    assert len(got) == (2 if keys else 1) and {r.n for r in got} == {1}


def test_views_read_a_base_and_few_batches(spark, folder):
    table, sink = f"{folder}/t", sinks.hot_sink(f"{folder}/t", "event_type_metrics", every=8)
    schema = "event_type string, window_start timestamp, n int"
    for i in range(40):
        row = (f"k{i % 5}", T0 + dt.timedelta(hours=i), i)
        assert sink(spark.createDataFrame([row], schema).coalesce(1), i)
    view = sinks.hot_table("event_type_metrics", 8)
    assert len(view.folders(spark, table)) <= 9
    want = {f"k{i % 5}": i for i in range(40)}
    assert {r.event_type: r.n for r in sinks.hot_view(spark, table, "event_type_metrics").collect()} == want
    assert not sink(spark.createDataFrame([("k9", T0, 9)], schema), 39)  # a repeated batch adds nothing
    assert view.drop_folded(spark, table) > 20
    assert {r.event_type: r.n for r in sinks.hot_view(spark, table, "event_type_metrics").collect()} == want
    assert sink(spark.createDataFrame([("k0", T0 + dt.timedelta(hours=99), 99)], schema), 40)
    assert {r.event_type: r.n for r in sinks.hot_view(spark, table, "event_type_metrics").collect()} == want | {"k0": 99}


def test_active_stream_query_holds_real_and_roaming_users(spark, data):
    got = REGISTRY["str13_stream_active_sessions"].run(spark, data)
    assert got.groupBy("users").count().where("count > 0").count() == 2
    roaming = got.where("users = 'roaming'").drop("users")
    assert plain(roaming) == plain(REGISTRY["str13_active_sessions_30m"].run(spark, data))
    assert roaming.where("countries LIKE '%,%,%'").count() > 0
    users = spark.read.parquet(f"{data}/events.parquet").where("user_id IS NOT NULL").select("user_id").distinct()
    assert plain(got.where("users = 'real'").select("user_id").distinct()) == plain(users)


def test_jobs_side_by_side_write_a_batch_once_and_equal_jobs_on_their_own(spark, folder, rows, monkeypatch):
    jobs = {"sessions": session_state.session_job(), "active": keyed.active_job(), "views": keyed.journey_job()}
    written, fed, broken = [], [], ["views"]
    plainly = keyed.staged
    monkeypatch.setattr(keyed, "staged", lambda batch, *a: written.append(1) or plainly(batch, *a))

    def then(name):
        if name in broken:
            raise RuntimeError(f"killed after {name}")
        fed.append(name)

    batches = [clicks(spark, rows[120 * i : 120 * (i + 1)]) for i in range(2)]
    with pytest.raises(RuntimeError, match="killed after views"):
        keyed.advance_all(batches[0], f"{folder}/all", 0, jobs, then, buckets=4)
    assert sorted(fed) == ["active", "sessions"] and len(written) == 1
    broken.clear()
    keyed.advance_all(batches[0], f"{folder}/all", 0, jobs, then, buckets=4)  # a repeated batch goes on where it stopped
    assert sorted(fed) == ["active", "active", "sessions", "sessions", "views"] and len(written) == 1
    keyed.advance_all(batches[1], f"{folder}/all", 1, jobs, then, buckets=4)
    assert len(written) == 2
    for name, job in jobs.items():
        for i, batch in enumerate(batches):
            assert keyed.advance(batch, f"{folder}/{name}", i, job, buckets=4)
            one, other = (keyed.batch_output(spark, f"{t}/{name}", name, i) for t in (folder, f"{folder}/all"))
            assert plain(one) == plain(other) and one.count() > 0
        assert plain(keyed.state_rows(spark, f"{folder}/all/{name}", job)) == plain(keyed.state_rows(spark, f"{folder}/{name}", job))
