"""Time the headline queries: one JSON line with the median of three runs after a warm-up.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Results go to the
``noop`` sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from hushlake.plans.catalog import QUERIES
from hushlake.session import build_session

HEADLINE = [
    "mask_documents",
    "mask_documents_fast",
    "merged_external_spans",
    "detect_distinct",
    "restore",
    "mask_conversations_both",
    "chunk_documents",
    "sanitize_log",
    "annotate_all",
    "requests_filtered",
    "requests_dedupe",
    "audit_stats_30d",
    "activity_30d",
    "cache_sessions",
    "match_targets",
    "decode_requests",
    "effective_types",
    "activity_stream",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
