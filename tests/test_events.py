"""Hand-made rows for semantics that are easy to get wrong."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import agents, events as ev
from tidemark.functions.orders import strict_gmv_delta
from tidemark.operators import adhoc, analytics, ingest, metrics, quality, search, sessions, tiers, tracking
from tidemark.sources.offsets import with_position

T0 = dt.datetime(2024, 3, 1)
SCHEMA = (
    "event_id string, user_id long, session_id string, event_type string, event_name string, "
    "properties string, url string, country string, city string, ts timestamp, date_partition string"
)


def click(i, seconds, user=1, kind="page_view", url="/a", country="US", session="s", name=None, props="{}"):
    ts = T0 + dt.timedelta(seconds=seconds)
    city = None if country is None else f"{country}-1"
    return (f"e{i:05d}", user, session, kind, name, props, url, country, city, ts, ts.strftime("%Y-%m-%d"))


def clicks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_gap_long_silence_keeps_the_session(spark):
    rows = [click(0, 0), click(1, 1800), click(2, 3661)]
    got = sessions.sessions(clicks(spark, rows)).orderBy("start_time").collect()
    assert [r.event_count for r in got] == [2, 1]
    assert got[0].duration_seconds == 1800


def test_bounce_edges_and_url_count(spark):
    rows = [
        click(0, 0, user=1, kind="click", url=None),
        click(1, 0, user=2),
        click(2, 0, user=3, url="/a", country="DE"),
        click(3, 5, user=3, url="/b", country="US"),
        click(4, 9, user=3, url="/a", country=None),
    ]
    got = {r.user_id: r for r in sessions.sessions(clicks(spark, rows)).collect()}
    assert [got[u].is_bounce for u in (1, 2, 3)] == [True, True, False]
    assert got[1].landing_page is None and got[1].unique_urls_count == 0
    assert (got[3].landing_page, got[3].exit_page, got[3].unique_urls_count) == ("/a", "/a", 2)
    assert got[3].countries == ["DE", "US"]


def brute_sessions(rows, gap):
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[1], r[9], r[0])):
        runs = by_user.setdefault(r[1], [])
        if not runs or (r[9] - runs[-1][-1][9]).total_seconds() > gap:
            runs.append([])
        runs[-1].append(r)
    return sorted(
        (u, run[0][9], run[-1][9], len(run), len({x[6] for x in run}), [x[6] for x in run])
        for u, runs in by_user.items()
        for run in runs
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_and_pages_equal_brute_force(spark, seed):
    """One user holds most rows; others are sparse."""
    rng = random.Random(seed)
    rows = [
        click(i, rng.randint(0, 200_000), user=rng.choice([1, 1, 1, 2, 3, 4]), url=f"/p{rng.randint(0, 9)}")
        for i in range(400)
    ]
    events = clicks(spark, rows)
    want = brute_sessions(rows, 1800)
    got = sessions.sessions(events).collect()
    assert (
        sorted((r.user_id, r.start_time, r.end_time, r.event_count, r.unique_urls_count) for r in got)
        == [w[:5] for w in want]
    )
    pages = sessions.session_pages(events).orderBy("user_id", "session_no", "position").collect()
    lists = {}
    for p in pages:
        assert p.position == len(lists.setdefault((p.user_id, p.session_no), []))
        lists[(p.user_id, p.session_no)].append(p.page)
    assert sorted(lists.values()) == sorted(w[5] for w in want)
    chunked = sessions.page_sequences(sessions.session_pages(events), chunk=3).collect()
    assert max(len(c.page_view_sequence) for c in chunked) <= 3
    assert sum(len(c.page_view_sequence) for c in chunked) == 400


@pytest.mark.parametrize("seed", [1, 2])
def test_active_sessions_equal_brute_force(spark, seed):
    """Runs that pass through many buckets, change session and fall silent."""
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys((1, 2), 0)
    for i in range(300):
        u = rng.choice([1, 1, 2])
        at[u] += rng.choice([30, 600, 1700, 1800, 1801, 4000])
        rows.append(
            click(i, at[u], user=u, session=rng.choice(["a", "a", "a", "a", "b", None]), country=rng.choice(["US", "DE", "FR", None, ""]))
        )
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[9], r[0])):
        old = state.get(r[1])
        goes_on = old and old[0] == r[2] and (r[9] - old[1]).total_seconds() <= 1800
        seen = list(old[3]) if goes_on else []
        if r[7] and r[7] not in seen:
            seen.append(r[7])
        state[r[1]] = (r[2], r[9], old[2] + 1 if goes_on else 1, seen)
        want[r[0]] = (state[r[1]][2], seen)
    for bucket in (600, 3600, 86_400):
        out = tracking.active_sessions(clicks(spark, rows), bucket_seconds=bucket).collect()
        assert {r.event_id: (r.event_count, r.countries) for r in out} == want


def test_positions_are_dense_for_any_cut(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    want = {}
    for g in "ab":
        ordered = sorted(r for r in rows if r[0] == g)
        want |= {r[2]: i for i, r in enumerate(sorted(ordered, key=lambda r: (r[1], r[2])))}
    for width in (1, 7, 1000):
        got = with_position(df, ["g"], [F.col("x"), F.col("id")], F.floor(F.col("x") / width)).collect()
        assert {r.id: r.position for r in got} == want


def test_user_agents(spark):
    rows = [
        ("Mozilla Windows Chrome/1", "desktop", "chrome"),
        ("Mozilla Android Tablet", "mobile", "other"),
        ("Mozilla iPad Safari", "tablet", "safari"),
        ("Mozilla Firefox", "desktop", "firefox"),
        ("Mozilla Chrome Edge", "desktop", "chrome"),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "ua string, d string, b string")
    got = df.select("d", "b", agents.device_type(F.col("ua")), agents.browser(F.col("ua"))).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)
    assert df.where("ua IS NULL").select(agents.active_device_type(F.col("ua"))).head()[0] == "desktop"


def test_rate_change_compares_emitted_windows(spark):
    rows = [click(i, s) for i, s in enumerate([0] * 10 + [3600] * 15 + [3 * 3600] * 5)]
    out = metrics.with_rate_change(metrics.global_metrics("1 hour")(clicks(spark, rows)))
    got = [round(r.rate_change_percent, 2) for r in out.orderBy("window_start").collect()]
    assert got == [0.0, 50.0, -66.67]


def test_rate_change_crosses_days_and_takes_a_previous_row(spark):
    rows = [click(i, s) for i, s in enumerate([86_000] * 4 + [5 * 86_400] * 2)]
    windows = metrics.global_metrics("1 hour")(clicks(spark, rows))
    seed = spark.createDataFrame([(8,)], "event_count long")
    out = metrics.with_rate_change(windows, seed).orderBy("window_start").collect()
    assert [r.rate_change_percent for r in out] == [-50.0, -50.0]


def test_top_urls_break_ties_by_name(spark):
    rows = [click(i, 0, url=f"/{i:02d}") for i in range(12)] + [click(99, 0, url="/11")]
    row = metrics.page_view_metrics("1 hour")(clicks(spark, rows)).head()
    assert [(t["value"], t["n"]) for t in row.top_urls] == [("/11", 2)] + [(f"/{i:02d}", 1) for i in range(9)]
    assert (row.total_page_views, row.unique_viewers) == (13, 1)


def test_blank_urls_count_as_views_but_not_as_urls(spark):
    row = metrics.page_view_metrics("1 hour")(clicks(spark, [click(0, 0, url="")])).head()
    assert row.total_page_views == 1 and row.top_urls == []


def test_ratio_and_funnel_without_views(spark):
    out = analytics.conversion_funnel()(clicks(spark, [click(0, 0, kind="purchase")])).head()
    assert out.product_to_cart_rate == 0.0 and out.users_completed_purchase == 1
    assert spark.range(1).select(ev.ratio(F.lit(3), F.lit(0))).head()[0] == 0.0


def test_trailing_average_counts_rows_not_days(spark):
    days = [0, 1, 2, 3, 5, 6, 7, 8, 9]  # day 4 is missing
    rows = [click(100 * d + i, d * 86_400) for d in days for i in range(d + 1)]
    out = analytics.daily_cohorts()(clicks(spark, rows)).orderBy("window_start").collect()
    counts = [d + 1 for d in days]
    want = [sum(counts[max(0, i - 6) : i + 1]) / len(counts[max(0, i - 6) : i + 1]) for i in range(len(days))]
    assert [r.seven_day_avg_events for r in out] == want


def test_geo_windows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [
        click(i, rng.randint(0, 4 * 86_400), user=rng.choice([1, 1, 2, 3, None]), kind=rng.choice(["error", "purchase"]))
        for i in range(200)
    ]
    got = {r.window_start: r for r in analytics.geo_analysis(clicks(spark, rows), 1).collect()}
    starts = {T0 + dt.timedelta(hours=h) for h in range(-24, 97)}
    for s in starts:
        inside = [r for r in rows if s <= r[9] < s + dt.timedelta(hours=24)]
        assert (s in got) == bool(inside)
        if inside:
            assert got[s].total_events == len(inside)
            assert got[s].unique_users == len({r[1] for r in inside} - {None})
            assert got[s].error_count == sum(r[3] == "error" for r in inside)


def test_journey_keeps_the_newest_fifty(spark):
    rows = [click(i, i, url=f"/{i}") for i in range(53)]
    row = tracking.latest_journeys(clicks(spark, rows)).head()
    assert row.page_count == 50
    assert [p.url for p in row.pages] == [f"/{i}" for i in range(3, 53)]
    counts = tracking.journey_updates(clicks(spark, rows)).orderBy("ts").collect()
    assert [r.page_count for r in counts] == [min(i + 1, 50) for i in range(53)]


def test_replay_takes_every_row_from_one_tier(spark):
    as_of = dt.datetime(2026, 1, 1)
    policy = tiers.RetentionPolicy()
    hot, warm = policy.hot_cutoff(as_of), policy.warm_cutoff(as_of)
    moments = [hot, hot - dt.timedelta(microseconds=1), warm, warm - dt.timedelta(microseconds=1)]
    rows = [(str(i), m, m.strftime("%Y-%m-%d")) for i, m in enumerate(moments)]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp, date_partition string")
    out = tiers.replay(df, df, df, dt.datetime(2020, 1, 1), as_of, policy, as_of).collect()
    assert {r.event_id: r.source for r in out} == {
        "0": "kafka",
        "1": "clickhouse",
        "2": "clickhouse",
        "3": "cold_storage",
    }
    # A range inside one tier reads nothing else.
    recent = tiers.replay(df, df, df, hot, as_of, policy, as_of)
    assert [r.source for r in recent.collect()] == ["kafka"]
    assert tiers.expire(df, policy, as_of).count() == 3
    status = tiers.retention_status(spark, policy, as_of).head()
    assert status.kafka_cutoff == "2025-12-25T00:00:00" and status.clickhouse_retention_months == 12


def test_hot_values_last_write_wins_and_expire(spark):
    rows = [("a", "1", T0), ("a", "2", T0 + dt.timedelta(seconds=5)), ("b", "3", T0)]
    puts = spark.createDataFrame(rows, "key string, value string, at timestamp")
    values = tiers.latest_values(puts, "key", F.col("value"), "at", F.lit(10))

    def live(seconds):
        now = F.lit(T0 + dt.timedelta(seconds=seconds))
        return sorted((r.key, r.value) for r in tiers.alive(values, now).collect())

    assert live(9) == [("a", "2"), ("b", "3")]
    assert live(10) == [("a", "2")] and live(15) == []
    assert tiers.lookup(values, "key", ["a", "zz"]).count() == 1
    keys = spark.createDataFrame([("b",), ("zz",)], "key string")
    assert {r.key: r.deleted for r in tiers.deleted_flags(values, "key", keys).collect()} == {"b": True, "zz": False}
    assert [r.key for r in tiers.without_keys(values, "key", keys).collect()] == ["a"]


def batch_text(n, kind="view", extra=""):
    return '{"batch_id":"b","events":[' + ",".join(f'{{"event_type":"{kind}"{extra}}}' for _ in range(n)) + "]}"


def test_batches_are_taken_or_refused_whole(spark):
    texts = [
        batch_text(2),
        batch_text(0),
        batch_text(1001),
        batch_text(1000),
        batch_text(1, kind=""),
        batch_text(1, extra=',"country":"USA"'),
        batch_text(1, kind="x" * 101),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    parsed = ingest.parse_batches(df)
    reasons = {r.i: r.batch_reject_reasons for r in ingest.refused_batches(parsed).collect()}
    assert reasons == {
        1: ["batch_empty"],
        2: ["batch_too_large"],
        4: ["events[0]: event_type_empty"],
        5: ["events[0]: country_too_long"],
        6: ["events[0]: event_type_too_long"],
    }
    out = ingest.batch_events(parsed, F.lit(T0)).where("i = 0").orderBy("batch_index").collect()
    assert [(r.batch_index, r.event_name) for r in out] == [(0, "view"), (1, "view")]
    assert out[0].event_id != out[1].event_id
    assert out[0].session_id == f"session_{int(T0.replace(tzinfo=dt.timezone.utc).timestamp())}_None"


def test_strict_delta_rejects_unknown_types(spark):
    df = spark.createDataFrame([("order_refunded",)], "t string").withColumn("a", F.lit(1).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="unknown event_type: order_refunded"):
        df.select(strict_gmv_delta(F.col("t"), F.col("a"))).collect()


def test_search_finds_words_not_substrings(spark):
    rows = [
        click(0, 0, url="/product/42"),
        click(1, 1, url="/product/421"),
        click(2, 2, url=None, props='{"note":"Blue shoe","n":42}'),
        click(3, 3, kind="purchase", url="/x", name="big_sale"),
    ]
    index = search.search_index(clicks(spark, rows))

    def ids(q):
        return [int(r.event_id[1:]) for r in search.search_page(search.search(index, q)).collect()]

    assert ids("42") == [2, 0]
    assert ids("SHOE purchase") == [3, 2]
    assert ids("big_sale") == [3] and ids("sale") == [] and ids("") == []
    assert search.search_total(search.search(index, "product")).head()[0] == 2
    page = search.search_page(search.search(index, "page_view"), size=1, start=1).collect()
    assert [r.event_id for r in page] == ["e00001"]


def test_adhoc_errors_are_raised(spark):
    df = spark.range(3)
    assert adhoc.query(spark, "SELECT count(*) c FROM {t} WHERE id >= :a", {"a": 1}, t=df).head()[0] == 2
    with pytest.raises(Exception, match="nothing_there"):
        adhoc.query(spark, "SELECT nothing_there FROM {t}", t=df).collect()


def test_realtime_metrics_knows_one_window_only(spark):
    counters = analytics.minute_counters()(clicks(spark, [click(0, 0), click(1, 59), click(2, 60)]))
    now = F.lit(T0 + dt.timedelta(seconds=30))
    assert analytics.realtime_metrics(counters, now).head().events_count == 2
    quiet = F.lit(T0 + dt.timedelta(hours=5))
    assert analytics.realtime_metrics(counters, quiet).head().events_count == 0
    assert analytics.realtime_metrics(counters, now, "5m").count() == 0


def test_drift_alert(spark):
    def table(rows):
        df = spark.createDataFrame(rows, "event_type string, amount string, event_time timestamp")
        return df.withColumn("amount", F.col("amount").cast("decimal(18,2)"))

    day2 = T0 + dt.timedelta(days=1)
    lake = table([("order_created", "1000.00", T0), ("order_created", "1000.00", day2)])
    fresh = table([("order_created", "1000.50", T0), ("order_created", "1002.00", day2)])
    out = quality.reconcile_daily(fresh, lake).orderBy("day").collect()
    assert [r.alert for r in out] == [False, True]
    only_fresh = quality.reconcile_daily(fresh, lake.where("false")).collect()
    assert all(r.alert for r in only_fresh) and len(only_fresh) == 2
