"""Headline queries, timed: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "census_profile_w5", "census_profile_grid", "census_w_sweep", "multi_instance_census", "equal_event_rho", "burstiness_pooled", "reservoir_sample",
    "edge_observations", "pattern_features", "crawl_features", "hajek_ht_oracle", "case_table", "metric_slices", "variance_components", "latest_answer_wins",
    "frozen_score", "timestamp_shuffle", "walk_logs", "mask_mle",
]


def main() -> None:
    from persistra.plans.queries import QUERIES
    from persistra.sources.scratch import clear

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES[names[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles and reads footers
    took = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        clear(spark)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
