"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from knotmeter.plans.queries import QUERIES
from knotmeter.session import build_session, drop_tables

HEADLINES = [
    "file_inventory", "primary_language", "file_statistics", "detect_services",
    "detect_pipelines", "detect_model_code_refs", "model_references", "detect_endpoints",
    "service_dependencies", "detect_frameworks_all", "direct_model_calls", "glue_code_ratio",
    "hidden_consumers", "impact_radius", "shared_features", "churn_by_file", "churn_lines",
    "bug_prone_files", "bugs_by_model", "repo_info", "commit_log_files", "mlflow_item_counts",
    "mes_scores", "mes_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM paths and the Python workers once, outside the timings
    QUERIES["file_statistics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "spark": spark.version,
            }
        )
    )
    drop_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
