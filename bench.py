"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (comma-separated) other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinlink.session import build_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINE = [
    "reciprocal_knn",
    "candidate_rank",
    "topk_report",
    "experiment_grid",
    "evaluate_run",
    "active_time",
    "attach_texts",
    "selecting_prompt",
    "match_pairs",
    "select_cascade",
    "truncate_tokens",
    "embed_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries()
    # Start the JVM's and the Python workers' share of the first query before the clock.
    every["cosine_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
