"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and its full result written to a sink that discards rows. ``store_build`` is the time
to analyse all logs and write the history tables that the history queries then read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "src_logs", "det_tool", "seg_dotnet", "seg_stats", "ext_all", "fpr_hash", "grp_fingerprint", "rnk_candidates", "nar_summary",
    "rul_match_diag", "rul_apply", "pat_fold", "pat_top", "pat_merge", "his_related", "sim_tokens", "sim_search", "nar_search",
    "kno_patterns", "kno_merge", "prv_redact_log", "prv_redact_raw", "prv_retention", "tel_analysis", "tel_http", "enr_candidate",
    "str_patterns",
]

# These read the history tables, which are written (and timed on their own) before the first of them.
HISTORY = {
    "pat_top", "pat_merge", "his_related", "sim_search", "kno_patterns", "kno_merge", "prv_retention", "str_patterns",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from faultlines.plans.queries import QUERIES, history
    from faultlines.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)

    def discard(name) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()
    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        if name in HISTORY and "store_build" not in times:
            timed("store_build", lambda: dict(history(spark, sf_dir)))
        timed(name, lambda: discard(name))
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
