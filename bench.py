"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of local threads,
BENCH_QUERIES (comma separated) other queries than the headline ones. Every
query runs once to warm up and is then timed from building its plan to
consuming its full result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from scoreloom.plans.catalog import QUERIES
from scoreloom.session import build_session

HEADLINE = (
    "metrics_summary", "classification_report", "strategy_metrics", "progress_classes",
    "bulk_accuracy_by_length", "bulk_length_crosstab_pct", "bulk_anova_length",
    "bulk_grade_length_describe", "bulk_ratio_boxplot", "split_sizes", "log_loss",
    "accuracy_by_length", "shortest_answers", "prompt_pair", "vocab_topk", "pair_encode",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    partitions = int(cpus) if cpus.isdigit() else os.cpu_count() or 4
    spark = build_session("scoreloom-bench", cpus, partitions)
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
