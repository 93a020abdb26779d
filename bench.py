"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each query is
run in full into Spark's no-op sink: once to warm up, then BENCH_RUNS times; the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from acceptance.catalog import CHECKS
from patchlight.session import local_session

HEADLINES = [
    "diff_chunks",
    "review_findings_default_words",
    "category_counts",
    "category_summary_by_review",
    "file_results",
    "review_result_json",
    "findings_with_comments",
    "training_set_default_words",
    "sample_per_category",
    "pending_prompts",
    "label_run",
    "label_audit",
    "stratified_folds",
    "classification_report",
    "continuous_review_findings",
    "chunk_embeddings",
    "classified_texts",
    "cross_validation_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores})
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        best = float("inf")
        for run in range(runs + 1):
            start = time.perf_counter()
            CHECKS[name].query(spark, sf).write.format("noop").mode("overwrite").save()
            if run:
                best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
