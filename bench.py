"""Headline queries at one scale; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. The result is
written to Spark's no-op sink, so no rows travel to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gustline.plans import catalog  # noqa: E402
from gustline.session import build_session  # noqa: E402

HEADLINE = ["merge_feeds", "lag_features", "roll_mean_strict", "long_series_features", "timed_features",
            "upsert_latest", "validate_clean", "diurnal_boxplot", "ks_statistic", "psi", "cv_rollup", "ridge_cv",
            "score_linear", "recursive_forecast"]
RUNS = 3      # after one run to warm up


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            registered[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
