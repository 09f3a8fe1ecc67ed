"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the Parquet tables. BENCH_CPUS: local cores. Each query runs once
untimed on the smallest sibling folder first, so that JVM warm-up is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "missing_by_column", "completeness_indicators", "distinct_counts", "duplicate_rows", "duplicate_documents",
    "numeric_describe", "numeric_describe_narrowed", "value_frequencies", "top_values", "top_documents",
    "text_variants", "histogram_24", "correlation_pairs", "outlier_counts", "box_stats", "class_distribution",
    "dedupe_keep_first", "duplicate_pairs", "fill_mode", "clip_outliers", "standardize", "change_audit",
    "recipe_replay", "overall_score", "metadata_items",
]


def main() -> None:
    from checks.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    chosen, seconds = sys.argv[1:] or HEADLINE, {}
    small = Path(sf).parent / "sf0.001"
    for name in chosen if small.is_dir() else []:
        QUERIES[name](spark, str(small)).write.format("noop").mode("overwrite").save()
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
