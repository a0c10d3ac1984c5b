"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mixledger.plans import all_queries  # noqa: E402
from mixledger.session import local_session  # noqa: E402

HEADLINE = [
    "check_lists",
    "list_counts",
    "collect_lists",
    "library_search_page",
    "organize_tracks",
    "heard_segments_exact",
    "coverage_gaps",
    "refine_points",
    "failed_share",
    "interpolate_times",
    "history_merge",
    "history_chunks",
    "interval_hints",
    "rank_sources",
    "device_diff",
    "tracklist_roundtrip",
    "round_robin_pilot",
    "submission_audit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cpus)
    queries = all_queries()
    times, cold = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        # The first run compiles code and warms caches; what is reported is the one after it.
        for into in (cold, times):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total warm wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold": cold,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
