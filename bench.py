"""Wall time per headline query: prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs after
one warm-up (the median counts), BENCH_QUERIES an optional comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from carequeue.session import build_session
from checks.queries import all_queries

HEADLINE = [
    "clinic_attention_index",
    "referral_lag",
    "appointment_completion",
    "no_show_summary",
    "open_aging_buckets",
    "funnel",
    "provider_capacity_all",
    "zip_friction",
    "clinic_performance",
    "weekly_access_trends",
    "segment_completion_gap",
    "kpi_window",
    "kpi_prior_period",
    "clinic_perf_filtered",
    "access_trends_week",
    "zip_friction_custom",
    "appt_type_no_show",
    "visit_mode_no_show",
    "segment_completion",
    "provider_capacity",
    "improvement_last30",
    "action_queue_dynamic",
    "dq_scorecard",
    "feature_table",
    "score_histogram",
    "question_route",
    "feature_imputed",
    "answer_open_aging",
    "metric_context",
    "risk_scores",
    "model_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__driver__extraJavaOptions="-XX:+UseParallelGC",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, queries = {}, all_queries()
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        found[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(found.values()), 3),
        "unit": "sec",
        "queries": found,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
