"""Time the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from levelframe.plans import registry
from levelframe.session import local_session

HEADLINE = (
    "label_to_hesse", "angular_error", "evaluation_summary", "precision_sweep", "split_aggregate", "metric_stats", "stratified_split", "temporal_fold", "scene_segments", "otsu_threshold", "gaussian_blur",
    "morph_close", "column_scan", "ols_fit", "ransac_top_k", "boundary_path", "region_coherence", "detect_a1", "detect_a2", "detect_a4", "detect_a5", "detect_a10",
    "evaluate_full_a10",  # frames of 480 x 480
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(memory="12g")
    known = registry.queries()
    known["angular_error"](spark, sf_dir).limit(1).collect()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
