"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below). Every query is
built and run anew, including its stage tables, and written to a sink that
discards rows. One untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from sievespark.plans.catalog import QUERIES
from sievespark.session import local_session
from sievespark.sources.stage import release

HEADLINE = [
    "v4_split_report", "k2_dictionary", "k3_dense_index", "k4_encode", "e1_consolidate", "v2_split_any", "v3_split_strict",
    "j2_star_features", "j2b_melt_features", "j5_semi_any", "b1_undersample_rows", "b4_share_sample", "b5_quota_sample",
    "x1_average_precision", "x8_report", "m9_scored_output", "m6_ensemble", "f1_fingerprint", "f3_token_pools",
    "f6_token_edges", "f7_wl_labels", "f9_standardise", "f11_reduction", "a5_pools", "j9_nearest_exact", "j9_nearest_cells",
    "j8_nearest_approx", "y9_mean_similarities", "y10_best_match", "t1_running_dictionary", "t2_running_counts",
    "f1_fingerprint_dense", "f4_descriptors", "z2_screening_output",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["c4_row_count"](spark, sf_dir).collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
