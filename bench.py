"""Headline queries, timed one after the other; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship_scale_separation",  # metric matrix and FPR-budget threshold per scale
    "agg05_exact_auc",
    "agg29_detection_aucs",
    "agg34_robustness_by_condition",
    "agg42_prediction_diagnostics",
    "agg31_paired_bootstrap",  # 200 replicates
    "win08_group_split",
    "win13_collapse_streak",
    "prj17_window_plan",
    "prj21_calibrator_apply",
    "agg16_combine_scales",  # window scores blended and combined
    "grid04_guided_filter",
    "grid09_connected_components",
    "agg19_region_descriptors",  # map to regions
    "grid21_block_dct_profile",
    "prj24_router",
    "prj28_verdict",  # routing, evidence, fusion, verdict
    "analysis_tile_verdicts",  # cells to verdicts, everything
)


def main() -> None:
    from pixelwarrant.plans.catalog import QUERIES
    from pixelwarrant.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_linenumber").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
