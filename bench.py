"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotworks.plans import catalog  # noqa: E402
from slotworks.session import local_session  # noqa: E402

HEADLINE = ["a02_source_auc", "a01_consensus", "w01_rank_candidates", "w02_select_series", "a35_plan_digest", "w04_order_slices",
            "a14_intensity_window", "a05_auc", "a08_percentile_ci", "w12_rank_blend", "a10_spearman", "a18_attention_pool", "a19_slot_stats",
            "a23_dim_std_stats", "a25_covariance_spectrum", "m02_ridge_fit", "m03_ridge_predict", "j09_merge_rules", "a27_report_groups",
            "a28_near_template_groups", "w14_group_folds", "w16_rolling_median"]


def timed(spark, name: str, root: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    names = list(catalog.QUERIES) if names == ["all"] else names
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "slotworks-bench")
    timed(spark, "a03_label_summary", root)  # start workers and compile once
    seconds = {n: round(timed(spark, n, root), 3) for n in names}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
