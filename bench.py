"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to its
full result; ``rows_per_sec`` relates its time to the deliveries or events it read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "b16_classify", "b12_payload_fingerprint", "c1_dedup_new", "c1_delivery_results", "c2_quarantine_merge",
    "c3_actor_identity_fold", "c4_repository_identity_fold", "c5_activity_fold", "c7_event_observations",
    "d6_plan_batches", "d10_match_items", "d16_apply_batch", "d24_finalize_batch", "f7_event_page",
    "g1_run_tally", "g2_coverage", "g3_backlog_metrics", "g5_batch_quality", "g14_source_health",
    "g15_quota_by_window",
)


def main() -> None:
    from feedledger.session import local_session
    from feedledger.workload import QUERIES, feed

    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, memory="12g")
    events = feed.events(spark, SF_DIR).count()
    # Python workers and the JVM's compiled code are warmed up once, outside the times.
    QUERIES["b16_classify"](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else SF_DIR).count()
    times, rates = {}, {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        rates[name] = round(events / times[name])
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": rates, "events": events,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "master": f"local[{CPUS}]"}))
    spark.stop()


if __name__ == "__main__":
    main()
