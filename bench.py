"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Every
query runs in full and writes all its rows to a sink that throws them away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scour.catalog import QUERIES  # noqa: E402
from scour.session import local_session  # noqa: E402

HEADLINE = [
    "clean_and_aggregate", "csv_source", "standardise_types", "impute_mean", "impute_median", "impute_mode", "impute_table",
    "outlier_census", "iqr_clipping", "zscore_nullify", "isolation_forest", "dedup_rows", "dedup_subset", "duplicate_census",
    "fuzzy_merge", "similar_pairs", "aggregate_mean", "aggregate_median", "equal_frequency_bins", "min_max_scale", "pivot_mean", "unpivot",
    "merge_inner", "one_hot_encode", "label_encode_many", "frequency_encode", "text_lowercase", "text_remove_stopwords", "text_remove_accents",
    "column_profile", "suggest_plan", "validate_cleaning", "planned_run", "moving_average", "longest_streak", "around_events", "last_before",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
