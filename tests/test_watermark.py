from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.watermark import merge_progress, safe_watermark, watermark_of

W = 1000
CASES = [
    ({0: 10_000, 1: 2_000}, 0, 2, 1_000),  # the slow partition decides
    ({0: 5_000, 1: 5_000}, 9_999, 2, 9_999),  # never backwards
    ({0: 10_000}, 500, 2, 500),  # an unheard partition holds T
    ({0: 8_000, 1: 9_000, 2: 8_500}, 0, 3, 7_000),
    ({}, 77, 2, 77),
    ({}, 77, None, 77),
    ({0: 10_000}, 500, None, 9_000),
]


def rule(spark, newest, lateness, previous, expected):
    progress = spark.createDataFrame(list(newest.items()), "partition_id int, max_event_time_ms long")
    return safe_watermark(progress, lateness, previous, expected).head()[0]


@pytest.mark.parametrize("newest,previous,expected,t", CASES)
def test_rule(spark, newest, previous, expected, t):
    assert rule(spark, newest, W, previous, expected) == t


def watermarks(spark, histories, lateness, expected):
    """T after every arrival of every history, by the rule, in one job."""
    rows = [(h, k, p, ms) for h, arrivals in enumerate(histories) for k, (p, ms) in enumerate(arrivals)]
    so_far = Window.partitionBy("h").orderBy("k")
    newest = [F.max(F.when(F.col("p") == p, F.col("ms"))).over(so_far) for p in range(expected)]
    steps = spark.createDataFrame(rows, "h int, k int, p int, ms long").select("h", "k", F.array(*newest).alias("newest"))
    heard = F.size(F.filter("newest", lambda v: v.isNotNull()))
    after = watermark_of(F.array_min("newest"), heard, lateness, 0, expected)
    out = steps.withColumn("t", F.max(after).over(so_far)).collect()
    found = {(r.h, r.k): r.t for r in out}
    return [[found[h, k] for k in range(len(arrivals))] for h, arrivals in enumerate(histories)]


@pytest.mark.parametrize("lateness", [0, 700, 5_000])
def test_t_is_monotone_and_below_every_bound(spark, lateness):
    rnd = random.Random(lateness)
    histories = [[(rnd.randint(0, 3), rnd.randint(0, 10**6)) for _ in range(rnd.randint(1, 60))] for _ in range(200)]
    for arrivals, ts in zip(histories, watermarks(spark, histories, lateness, 4), strict=True):
        newest: dict[int, int] = {}
        t = 0
        for (partition, ms), after in zip(arrivals, ts, strict=True):
            newest[partition] = max(newest.get(partition, 0), ms)
            assert after >= t
            if after > t:
                assert len(newest) == 4 and after == min(newest.values()) - lateness
            elif len(newest) == 4:
                assert t >= min(newest.values()) - lateness
            t = after


def test_nothing_below_t_is_still_to_come(spark):
    """Dynamic safety: partitions with disorder below W, drained at any relative speed."""
    rnd = random.Random(7)
    histories = []
    for _ in range(200):
        logs = {p: [i * 10 + rnd.randint(0, W - 1) for i in range(rnd.randint(1, 40))] for p in range(3)}
        order = [p for p in logs for _ in logs[p]]
        rnd.shuffle(order)
        position = dict.fromkeys(logs, 0)
        arrivals = []
        for p in order:
            arrivals.append((p, logs[p][position[p]]))
            position[p] += 1
        histories.append(arrivals)
    for arrivals, ts in zip(histories, watermarks(spark, histories, W, 3), strict=True):
        for k, t in enumerate(ts):
            assert all(ms >= t for _, ms in arrivals[k + 1 :])


def test_progress_merge_keeps_silent_partitions(spark):
    schema = "partition_id int, next_offset long, max_event_time_ms long"
    before = spark.createDataFrame([(0, 10, 500), (1, 4, 900)], schema)
    new = spark.createDataFrame([(0, 12, 450)], schema)
    rows = {r.partition_id: (r.next_offset, r.max_event_time_ms) for r in merge_progress(new, before).collect()}
    assert rows == {0: (12, 500), 1: (4, 900)}
