"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rankloom.plans.registry import QUERIES
from rankloom.session import INPUT_TASKS, build_session

HEADLINE = (
    "shortlist_by_match", "clean_text", "chunk_words", "jd_fields", "skill_pool",
    "span_stats", "chunk_maxsim", "app_wide", "snapshot_asof", "flag_counts",
    "candidate_total", "tfidf", "stuffing_flag", "perplexity", "shortlist_top_fraction",
    "stratified_test", "composite_rank", "job_ranking", "embed", "activity_stream_counts",
    "close_due_jobs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            INPUT_TASKS: cpus,  # the tables are files of one row group
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # session start is not a query
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(sorted(took)[len(took) // 2], 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "spark": spark.version,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
