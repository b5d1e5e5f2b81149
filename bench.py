"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list) select what runs. A query's time covers building
its plan, jobs it starts on the way, and writing the result to the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from treemend.catalog import load
from treemend.session import local_session

HEADLINE = [
    "doc_schema", "string_agg_ordered", "build_index", "descendant_counts", "run_qc", "qc_flags_one_pass", "qc_uniqueness",
    "qc_consistency", "qc_entirety", "qc_curve_spikes", "knn_neighbors", "curve_smooth", "pick_sample_lookup", "surface_idw",
    "run_predictions", "failure_counts", "merge_duplicates", "fix_duplicate_curves", "merge_upsert", "csv_key_fix_dedupe",
    "las_curve_values", "incremental_transfer", "end_to_end_run",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, "treemend-bench")
    queries, _ = load()
    # start the JVM's readers and code generator before the clock runs
    spark.read.parquet(f"{folder}/customer.parquet").groupBy("c_nationkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
