"""Headline timings: one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Each query is
written out in full (no column is pruned away by a count); the first run of a
query warms up, the median of the following runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "S02_parquet_scan", "R04_join_outer", "R06_range_join", "R07_asof_join", "R08_group_by", "R11_running_total", "R14_top_k_per_group",
    "P01_profile", "P10_distributions", "P12_duplicate_timestamps", "P15_text_quality_documents", "P19_encoding_issues", "P25_fuzzy_pairs",
    "P28_scaling_report", "P33_scan_pii_documents", "P35_temporal_gaps", "P38_ks_drift", "P43_statistics",
    "C03_impute_group", "C04_ffill", "C12_clip_iqr", "C19_clean_html", "C29_scale_robust", "C31_resample",
    "F03_lags", "F04_rolling", "F10_sentiment", "F11_frequency_encode", "M04_join_audit", "T04_chi2", "T06_spearman", "T09_kruskal",
    "A04_rfm", "A06_cohort_month", "A10_pair_rules", "A12_decompose_additive", "L07_forecast", "V02_histogram_data",
]


def main() -> None:
    from tallygrid.catalog import QUERIES
    from tallygrid.session import build_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("tallygrid-bench", f"local[{cpus}]", cpus, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        out[name] = round(statistics.median(times[1:]), 3)
        print(name, out[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": float(Path(sf).name.removeprefix("sf")), "cpus": cpus}))


if __name__ == "__main__":
    main()
