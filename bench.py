"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_REPEATS (default 3).
Each value is the median over the repeats after one warm-up run; the result is written to Spark's noop sink, so
every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.queries import QUERIES  # noqa: E402
from tablewright.session import local_session  # noqa: E402

HEADLINES = [
    "agg_sum", "agg_median", "agg_top_n_colour", "profile_table", "profile_types_lineitem", "describe_numeric",
    "eda_summary_lineitem_gaps", "corr_pearson", "corr_spearman", "eda_outliers_lineitem_gaps", "eda_findings_part",
    "dq_duplicate_rows", "dq_score_events", "dq_issues_events_dirty", "dq_decide_plan_events_dirty",
    "prep_fill_median", "prep_ffill", "prep_ffill_by_user", "prep_dedup_first", "filter_compound", "outlier_cap",
    "text_clean_title", "derive_percentage", "chart_grouped_bar", "chart_histogram", "chart_box", "chart_ecdf",
    "chart_treemap", "dash_time_trend_m", "dash_executive", "inv_by_bins", "ask_intent", "ask_extreme_highest",
    "log_kpis_all", "log_feed", "log_user_upsert",
]


def timed(run, spark, directory: str) -> float:
    start = time.perf_counter()
    run(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = sys.argv[1:] or HEADLINES
    spark = local_session(os.environ.get("BENCH_CPUS", "4"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        timed(QUERIES[name], spark, directory)
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, directory) for _ in range(repeats)), 3)
    spark.stop()
    result = {
        "metric": "total seconds, sum of per-query medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
