"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py --all`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from apexframe import plans
from apexframe.session import local_session

HEADLINE = (
    "A1_outliers", "A3_sector_baselines", "A8_age_residual_bins", "A11_pit_losses", "A13_r2_by_knob", "A25_readiness_summary",
    "A33_rewrite_scorecard", "A37_outcome_distribution", "C1_race_snapshot", "C2_candidates", "E16_position_change", "F9_fact_preservation",
    "F20_sector_projection", "J5_latest_state_as_of", "J6_nearest_baseline", "J13_rewind_invalidation", "K1_insert_if_absent",
    "R4_sector_snapshot_stream", "R6_lockup", "R11_pit_states", "S2_lap_packets", "W3_recent_times", "W12_best_lap_table", "W17_rolling_slow_lap",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    queries = plans.queries()
    names = list(queries) if "--all" in sys.argv else [n for n in HEADLINE if n in queries]
    queries[names[0]](spark, folder).limit(1).collect()  # start the workers before the clock
    times = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        if "--all" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
