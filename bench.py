"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parcelcheck.catalog import QUERIES
from parcelcheck.session import local_session

HEADLINE = [
    "a2_reason_counts",
    "g9_repair_audit",
    "g14_protruding",
    "j1_ecoregion",
    "j2_country",
    "j3_overlap",
    "v5_subplot_layer",
    "p6_subplot_unpivot",
    "s2_linked_levels",
    "a1_density",
    "q3_coverage_counts",
    "q11_height_outliers",
    "q14_circumference_outliers",
    "w2_duplicate_ids",
    "r1_mean_ndvi",
    "r3_crow_distance",
    "r4_road_distance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
