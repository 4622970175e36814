"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "missing_filter",
    "median_normalize",
    "median_cv",
    "dynamic_range",
    "sample_correlation",
    "combat_correct",
    "ols_paired",
    "moderated_paired",
    "welch_p_values",
    "benjamini_hochberg",
    "discordance",
    "slope_estimates",
    "rowwise_permutation_p",
)


def main() -> None:
    from quantgrid.catalog import QUERIES
    from quantgrid.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["detection_mask"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
