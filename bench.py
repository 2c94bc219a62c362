"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores, BENCH_QUERIES (comma list) other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gaugeline.session import build_session
from suite import CATALOGUE

HEADLINE = [
    "hourly_level_with_gaps",
    "clean_telemetry",
    "grid_join",
    "resample_hour",
    "resample_5min",
    "gap_blocks",
    "spline_fill",
    "wide_impute",
    "lag_features",
    "rolling_mean_std",
    "rolling_sum",
    "rolling_mode",
    "value_ecdf",
    "score_percentiles",
    "ecod_score",
    "consensus_flag",
    "pivot_wide",
    "feature_table",
    "standard_scale",
    "walk_forward",
    "horizon_scores",
    "general_evaluation",
    "case_evaluation",
    "stored_encoder",
    "resample_two_months",
    "arx_coefficients",
    "chunk_plan",
    "best_upsert",
    "etl_hourly_wide",
    "outlier_removal",
    "feature_snapshot",
    "gbt_forecast",
    "parameter_sweep",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One run over the smallest tables starts the Python workers and compiles the code that is timed afterwards.
    small = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001"))
    for name in names if os.path.isdir(small) else []:
        CATALOGUE[name][0](spark, small).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        CATALOGUE[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}))


if __name__ == "__main__":
    main()
