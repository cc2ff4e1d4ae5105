"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Shared inputs are built once and paid for by the first query that reads them: the links
by link_matches, the features by ticket_features, held-out rate scores and the show shock
by show_shock, rate scores of upcoming shows by forecast_interval, invitations and actions
by invite_candidates and actions. Later queries reuse them, as a real run does.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES, Inputs  # noqa: E402
from turnout.session import local_session  # noqa: E402

HEADLINE = [
    "expected_attendance",
    "link_matches",
    "ticket_features",
    "history_asof",
    "rate_by_type",
    "rate_by_bands",
    "rate_grouping_sets",
    "show_residuals",
    "baseline_b3",
    "grouped_folds",
    "event_metrics",
    "calibration_table",
    "ranking_metrics",
    "bootstrap_mae",
    "show_shock",
    "forecast_interval",
    "coverage_by_band",
    "group_shock",
    "invite_candidates",
    "actions",
    "overbooking",
    "arrival_profile",
    "door_sheet",
    "m1_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "turnout-bench", "16g")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(spark.read.parquet(os.path.join(folder, "nation.parquet")))  # start the JVM's reader
    times = {}
    for name in names:
        t0 = time.perf_counter()
        noop(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:24s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    Inputs._all.clear()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
