"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Each query runs once to warm
up, then BENCH_RUNS times (default 3); the median counts. Results go to a sink that
reads every row and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelgrid.plans.registry import all_queries  # noqa: E402
from reelgrid.session import build_session  # noqa: E402

HEADLINE = (
    "index_write", "search_index_stats", "search_corpus_stats", "search_bm25_and", "search_bm25_batch",
    "search_snippet", "transcript_parse", "transcript_nested", "payloads", "guardrail",
    "path_scan", "recording_detail", "transcript_upsert", "segment_replace", "session_backfill",
    "job_update", "job_queue_per_kind", "job_report", "recovery_summary", "job_state_fold",
    "cleanup_plan", "timeline_blocks", "mix_gain", "resample", "pcm_decode", "format_report",
)


def timed(run, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run = queries[name][0]
        timed(run, spark, sf_dir)
        seconds[name] = round(statistics.median(timed(run, spark, sf_dir) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
