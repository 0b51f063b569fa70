"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.  Every query
runs to a full result (the ``noop`` sink) once unmeasured and then ``BENCH_RUNS`` times; the
best run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import CATALOG  # noqa: E402

HEADLINE = (
    # reports and features
    "hourly_patterns", "state_summary", "city_hotspots", "weather_category_impact",
    "severity_percentiles_by_state", "individual_equipment_analysis", "state_rankings",
    "all_reports", "create_features", "weather_aggregated", "infrastructure_features",
    # cleaning
    "dedup_by_key", "adaptive_null_handling", "zscore_filter_sequential",
    "zscore_filter_independent", "corrupt_row_filter", "clean_incidents",
    "incident_steps_preset",
    # quality
    "null_profile", "column_profile", "numeric_range_validation_lineitem", "iqr_outliers",
    "duplicate_analysis", "duplicate_analysis_incidents", "quality_report", "row_issues",
    # joins, serving, layout, sources
    "sized_equi_join", "bucketed_join", "radius_join", "geo_hotspots",
    "infrastructure_analysis", "kpi_long_table", "distribution_analysis", "csv_scan_strict",
    "write_bronze", "stream_ingest",
    # whole flows
    "ingest_to_bronze", "build_silver",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wayside bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, best run, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
