"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (median of that many) set the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postwarden.plans.registry import QUERIES
from postwarden.session import build_session

HEADLINE = (
    "hourly_trends",
    "dashboard_metrics",
    "alerts",
    "top_clusters",
    "cluster_spikes",
    "batch_metrics",
    "scored_record",
    "clean_text",
    "impute_median",
    "cluster_pressure",
    "pressure_at_insert",
    "apply_corrections",
    "correction_history",
    "live_fraud_feed",
    "ema_anomaly",
    "tag_batch_anomaly",
    "replay_schedule",
    "system_mode",
    "tfidf_weights",
    "similar_prior_postings",
    "assign_clusters",
    "score",
    "window_metrics_sink",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hourly_trends"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
