"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from concord.plans import QUERIES
from concord.plans.feeds import frame
from concord.session import build_session, release_scratch

HEADLINE = [
    "ingest_acknowledge",
    "ingest_first_delivery",
    "record_normalize",
    "policy_route",
    "identity_resolve",
    "identity_clusters",
    "conflict_merge",
    "replay_canonical",
    "replay_changes",
    "failure_dispatch",
    "dead_letter_settle",
    "fullsync_events",
    "reconcile_findings",
    "report_convergence",
    "report_lockouts",
    "metric_rate",
    "metric_exact_percentiles",
    "alert_event_failure_rate_high",
    "stream_apply",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "concord-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="concord-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = frame(spark, sf_dir, "change_feed").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release_scratch(spark)
    rates = {
        "ingest_events_per_s": round(events / seconds["ingest_acknowledge"], 1),
        "apply_events_per_s": round(events / seconds["replay_canonical"], 1),
        "stream_apply_events_per_s": round(events / seconds["stream_apply"], 1),
    }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
