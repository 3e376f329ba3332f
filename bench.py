"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line. Every query is built and run in full (all rows, all
columns, into a sink that drops them) once cold and then ``BENCH_RUNS`` times;
the reported seconds are the median of the later runs, building included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from renewlens.plans.catalogue import QUERIES
from renewlens.session import local_session

HEADLINE = (
    "customer_360",
    "policy_comparison",
    "compare_policy_docs",
    "risk_change",
    "analyze_risk_docs",
    "claim_summary",
    "document_signals",
    "extractive_summary",
    "interaction_docs",
    "text_search",
    "vector_search",
    "substring_search",
    "model_json_fallback",
    "nba_ranked",
    "nba_documents",
    "action_log_append",
    "action_history_top10",
    "quality_report",
    "stream_risk_alerts",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus) if cpus.isdigit() else cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
