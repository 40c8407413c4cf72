"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veritrace.plans.catalog import QUERIES  # noqa: E402
from veritrace.session import build_session  # noqa: E402

HEADLINE = [
    "conformance", "alignment_fitness", "dfg", "variants", "train_test_conformance", "process_reward",
    "embedded_csv_to_events", "grade_responses", "grade_distinct_pairs", "grade_mathd", "normalize_string",
    "normalize_symbolic", "numeric_equal", "token_f1_join", "span_overlaps", "pass_at_k_by_category",
    "running_majority", "equiv_vote", "group_advantage", "language_consistency", "ensure_id", "stream_dfg",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not part of any query
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
