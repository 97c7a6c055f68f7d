"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tracewell import plans
from tracewell.session import local_session

HEADLINE = (
    "detected_records", "e2_grouped_quantiles", "e11_horizons", "e12_error_rows", "e13_auroc", "e16a_robust_scale_relative",
    "e21_column_profile", "e22_facets", "c9_reconcile", "d5_conformal_p_values", "d6_interval_means", "d7_asof", "d8_kth_neighbour",
    "f5_onset", "f10_holm", "g3_conformal_thresholds", "k1_strided_windows", "k12_feature_rows", "k11_fourier_codes", "l1_sample_covariance",
    "l5_mahalanobis", "l19_stratified_bootstrap", "l20_method_comparison", "l23_weighted_conformal", "l26_curve_surrogate",
    "l32_rollout_errors", "l38_fold_evaluation", "n1_tumbling_windows")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "tracewell-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").write.format("noop").mode("overwrite").save()
    taken = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
                      "queries": taken, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
