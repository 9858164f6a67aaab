"""Headline queries timed on one data set; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuseval import catalog, get_spark  # noqa: E402

HEADLINE = [
    "aggregate_runs",
    "compare_items",
    "delta_summary",
    "compare_coverage",
    "trend",
    "evidence_gate",
    "review_table",
    "review_queue",
    "latest_report",
    "status_counts",
    "sequence_ids",
    "prepare_dataset",
    "pending_items",
    "run_summary",
    "last_wins",
    "bbox_union",
    "covered_pixels",
    "edge_impact",
    "accept_lines",
    "cascade",
    "mark_text",
    "mark_audit_docs",
    "mark_audit_pages",
    "token_hits",
    "mean_abs_diff",
    "mask_overlap",
    "edge_delta",
    "evaluate",
    "stream_progress",
    "stream_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__checkpoint__dir=scratch,
        spark__local__dir=scratch,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["aggregate_runs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
