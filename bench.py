"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from copycensus.plans.queries import REGISTRY  # noqa: E402
from copycensus.session import build_session  # noqa: E402

HEADLINE = [
    "identity_digests", "text_signatures", "signal_hashes", "redundancy_audit", "global_summary",
    "global_summary_events", "global_summary_lineitem", "cross_split_overlap", "per_class_summary",
    "mixed_label_groups", "exact_census", "verify_exact_groups", "dedup_retained", "dedup_removed",
    "dataset_overview", "stratified_split", "stratified_split_lineitem", "group_development_split",
    "protocol_pair", "class_partition_counts", "paired_conditions", "condition_exposure",
    "condition_exposure_global", "condition_summary", "hash_pair_stats", "hash_vote_stats",
    "key_vote_stats_lineitem", "nearest_centroid_predictions", "overall_scores", "contrast_summary",
    "score_recompute", "annotation_strata", "pair_metric_summary", "empirical_cdf",
    "protocol_reuse_check", "snapshot_digest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small query starts the session's threads and code paths.
    REGISTRY["global_summary_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
