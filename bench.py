"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the data directory, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from perinuc.plans import QUERIES  # noqa: E402

# one or two per family: stability, summaries, pairing, documents, curves, profiles, pixels, detection, ledger
HEADLINE = [
    "a7_ne_stability",
    "a10_compare_stability",
    "a12_delta_stats",
    "a1_summary_stats",
    "a15_histogram_by_width",
    "a18_distance_stats",
    "a21_segment_quality",
    "a25_kept_vs_filtered",
    "j6_iou_best_match",
    "j7_greedy_pair",
    "j8_mask_pair",
    "s1_catalog",
    "s9_unpack_reg_slice",
    "s12_unpack_distances",
    "w4_cumulative_length",
    "w6_bend_filter",
    "j20_resample",
    "j17_signed_distance",
    "a18_measured_pairs",
    "w10_u_range_table",
    "a36_profile_edge",
    "a38_delta_aic",
    "j19_sample_along_normals",
    "a28_slice_means",
    "a9_label_regions",
    "a41_shift_by_correlation",
    "a42_bin_drift",
    "d1_sliding_rois",
    "a40_roi_llr",
    "w11_fdr",
    "w13_ledger_state",
    "a26_pruned_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        # the whole result is computed, nothing is sent to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
