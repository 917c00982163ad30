"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. `prepare_transitions` writes the
prepared transition table that the study queries read, as a prepare job would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from policylake.plans import catalog  # noqa: E402
from policylake.session import local_session  # noqa: E402
from policylake.sources import adapters  # noqa: E402

HEADLINE = [
    "slice_action_reward", "a1_one_second_aggregate", "w1_transition_builder", "s16_dataset_manifest",
    "v6_transition_audit", "v7_recorded_action_audit", "w2_discounted_return", "p6_outcome_costs",
    "d1_governed_decision", "w5_dwell_churn_guard",
    "w8_ensemble_forecast", "d2_gated_selection", "d4_evaluator_scores", "d9_hybrid_profiles",
    "d11_calibration_grid", "a10_cluster_accounting", "d18_shadow_recommendation", "d14_three_slice_knapsack",
    "r2_group_exact_permutation", "r3_cluster_inference", "a15_ood_detection", "w15_conformal_p_value",
    "s11_metric_alias_mapping", "p9_feature_completion",
    "j11_nearest_neighbour_distance", "d15_joint_profiles", "t2_stream_dwell_guard",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "policylake-bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # start the executor before timing
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    adapters.prepared(spark, sf).count()
    times["prepare_transitions"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
