"""Time the headline queries: `BENCH_SF_DIR`, `BENCH_CPUS`, `BENCH_RUNS`, or query names as arguments.

Prints one JSON line with the median seconds of the warm runs of each query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from careflow.plans.catalog import QUERIES
from careflow.session import build_session

HEADLINE = [
    "binned_states", "wide_states", "sample_and_hold", "fio2_estimate", "vital_completion", "interp_by_stay", "interp_global", "knn_block",
    "time_bins_closed", "interval_volume", "interval_median_max", "running_balance", "nearest_event", "onset", "contain_fallback",
    "range_join_stay", "coded_flags", "dose_standardise", "score_bands", "cohort_table", "zscore", "action_bins", "transition_model",
    "soft_policy", "row_scores", "discounted_return", "ema_q", "wis_boot", "excess_bins", "lineage_up", "quantised_series", "spline_coeffs",
    "patient_states",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]} (first {taken[0]:.2f})", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
