"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
``python bench.py --all`` times every registered query and also prints a line per query to stderr.
A query whose first run stays below QUICK_S counts with the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import plans  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "classify_state", "robust_anomaly", "climatology_pairs", "zone_statistics", "zone_screen", "per_sensor_zscore", "asof_bracket", "successive_change",
    "hue_angle", "significance_mask", "quality_screen", "erode", "dilate", "connected_components", "distance_transform", "water_mask_glint", "detect_candidates",
    "mosaic_first_valid", "datatake_group", "spectral_resample", "fingerprint", "rx_anomaly", "matchup_build", "nearest_asset_join", "exposure_assess", "drift_bounds",
    "priority_rules", "replay_status", "payload_validate", "audit_chain_verify", "auroc", "grouped_bootstrap", "promotion_gate", "incremental_screen",
    "local_median_dark", "rx_percentile_region", "sampling_plan", "blocked_cv_compare",
]
QUICK_S = 8.0


def timed(query, spark, sf_dir: str) -> float:
    t0 = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    queries = plans.load().QUERIES
    names = list(queries) if "--all" in argv else [a for a in argv if a in queries] or HEADLINE
    queries["scl_usable"](spark, sf_dir).write.format("noop").mode("overwrite").save()      # start the JVM's code paths
    seconds = {}
    for name in names:
        try:
            runs = [timed(queries[name], spark, sf_dir)]
            while len(runs) < 3 and runs[0] < QUICK_S and "--all" not in argv:
                runs.append(timed(queries[name], spark, sf_dir))
            seconds[name] = round(statistics.median(runs), 3)
        except Exception as e:                                                          # noqa: BLE001
            seconds[name] = None
            print(f"{name}: {type(e).__name__} {str(e)[:300]}", file=sys.stderr)
        if len(argv) > 0:
            print(f"{name:32s} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(v for v in seconds.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main(sys.argv[1:])
