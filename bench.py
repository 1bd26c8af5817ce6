"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "profile_lineitem_columns", "profile_numeric_statistics", "profile_pearson_correlations", "profile_histograms",
    "assess_lineitem_issues", "check_numeric_outliers_iqr", "check_numeric_outliers_zscore", "check_duplicate_rows",
    "check_case_inconsistency", "check_multivariate_outliers", "rule_cross_fields", "relate_key_overlaps",
    "relate_orphan_issue", "drift_snapshot_signals", "diff_frames", "score_quality", "transform_clip_outliers",
    "transform_fill_forward", "steps_ordered_cleaning", "integrity_reject_orphans", "dedup_keep_latest",
    "load_scd2_only_changed", "load_reject_quarantine", "near_duplicate_documents", "dedup_sorted_neighbourhood",
    "stream_window_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from plumbline.queries import catalog
    from plumbline.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # one small job so that no query pays for the start of the engine
    catalog.QUERIES["probe_remaining_nulls"](spark, sf_dir).collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
