"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.
Each query is written to a no-op sink, so every row and column is computed. The
reported time is the faster of two runs, after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tabletrail import suite
from tabletrail.plans import release_scratch
from tabletrail.session import local_session

HEADLINE = [
    "batch_stats", "rank_by_significance", "top_counts_events", "enrich_inner", "enrich_left", "group_zscore_outliers", "group_moments",
    "dedup_last_wins", "ordered_distinct", "volcano_calls", "row_zscore_matrix", "sample_alignment", "pairwise_distance", "matrix_long",
    "ttest_pooled", "ttest_welch", "ttest_p_values", "linear_model_two_group", "toptable_moderated", "bh_adjust", "bh_adjust_continuous",
    "box_summary", "strip_points", "heatmap_cells", "exchange_orders", "factor_decode", "typed_elements", "table_fingerprint",
    "audit_outputs", "audit_inputs", "audit_unlisted", "audit_check", "catalog_listing", "unit_code_deps", "manifest_scan", "publish_roundtrip",
    "walk_files",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or os.cpu_count() or 1
    spark = local_session("tabletrail-bench", cores, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = suite.queries()
    names = sys.argv[1:] or HEADLINE

    def timed(name: str) -> float:
        start = time.perf_counter()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed("batch_stats")
    times = {}
    for name in names:
        times[name] = round(min(timed(name), timed(name)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
