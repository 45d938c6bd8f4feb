"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every query is run to its last row; the best of BENCH_RUNS runs (default 2) counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans.catalog import REGISTRY
from tidemark.session import local_session

HEADLINES = {
    "seam_totals": "agg3_seam_totals",
    "safe_watermark": "agg7_safe_watermark",
    "log_offsets": "src14_order_events",
    "wire_decode": "src4_wire_decode",
    "id_sets": "jn2_set3_id_sets",
    "order_lifecycle": "jn3_order_lifecycle",
    "global_metrics": "agg12_win4_global_metrics_1s",
    "event_type_metrics": "agg13_event_type_metrics_1s",
    "country_metrics": "agg14_country_metrics_1s",
    "active_users": "agg15_active_users_1m",
    "page_views_top10": "agg16_top1_page_views_1s",
    "error_metrics": "agg17_error_metrics_1s",
    "hourly_stats": "agg18_hourly_stats",
    "daily_user_metrics": "agg20_daily_user_metrics",
    "daily_cohorts": "agg21_win1_daily_cohorts",
    "user_journeys": "agg22_user_journeys",
    "conversion_funnel": "agg23_conversion_funnel",
    "geo_analysis": "agg26_geo_analysis_min2",
    "sessions": "agg27_sessions_30m",
    "daily_sessions": "agg29_top6_set4_daily_sessions_30m",
    "session_pages": "str6_top2_session_pages_6h",
    "active_sessions": "str13_active_sessions_30m",
    "replay": "snk14_set2_replay",
    "search": "top4_search_page",
    "landing_exactly_once": "snk1_agg3_landed_seam",
    "crash_restart": "str11_plan4_crash_recovery",
    "watermark_safety": "src6_snk2_lake_below_t",
    "stream_metrics": "str1_str17_snk8_hourly_stats",
    "stream_sessions": "str5_stream_sessions_30m",
}


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name, query in HEADLINES.items():
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[query].run(spark, root).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(root).name,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
