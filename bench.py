"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loadlens.plans.catalog import load_all  # noqa: E402
from loadlens.session import build_session  # noqa: E402

# Name -> repetitions after one warm-up run.
HEADLINE = {
    "ingest_daily": 2,
    "daily_rollup": 2,
    "horizon_table": 2,
    "overuse_alarm_evaluation": 2,
    "baseline_evaluation": 2,
    "error_by_dimension": 2,
    "sliding_evaluation": 2,
    "interpolate_missing": 2,
    "outlier_iqr": 2,
    "ami_monthly": 2,
    "monthly_tou_ratios": 2,
    "final_bill": 2,
    "btm_detect": 2,
    "monthly_weather_features": 2,
    "base_temperature_grid": 2,
    "profile_load_distribution": 2,
    "profile_data_quality": 2,
    "profile_correlation_matrix": 2,
    "feature_matrix": 2,
    "residual_model_evaluation": 1,
}


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, {
        "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.log.level": "ERROR"})
    registry = load_all()
    names = [n for n in sys.argv[1:] if n in registry] or list(HEADLINE)
    times = {}
    for name in names:
        runs = []
        for i in range(HEADLINE.get(name, 1) + 1):
            t0 = time.perf_counter()
            registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            print(f"{name} run {i}: {runs[-1]:.2f}s", file=sys.stderr, flush=True)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
