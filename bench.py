"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["clean_vocab", "sessionize", "session_table", "event_counts", "dwell_by_step", "prefix_features", "session_joins", "rules_flags",
            "gateway_anomalies", "anomaly_members", "gateway_health", "message_cap", "workflow_fold", "confidence_gate", "funnel",
            "ranking_metrics", "draft_policy"]


def main() -> None:
    from waymark.plans import checks
    from waymark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    checks.QUERIES["funnel"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    took: dict[str, float] = {}
    for name in HEADLINE:
        checks.forget()  # every query builds all its inputs itself
        start = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
