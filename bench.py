"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed on a second run that writes its result nowhere.
"""

from __future__ import annotations

import json
import os
import time

from oratorio.plans.registry import queries
from oratorio.session import session

HEADLINE = (
    "g1_clip_rollup", "g2_pooled_rate", "g3_breakdown_share", "g4_numbers", "g6_confusion", "g6_both_ways", "j3_confusion_vs_base", "g8_rule_evidence", "g13_mh_ratio", "g14_card", "g16_bootstrap_ci",
    "j13_interval_join", "j16_interval_anti", "j18_band_context", "w1_latest", "w3_topk_per_group", "w13_islands", "g28_category", "g31_profiles", "g33_cost_vendor_day", "p25_filter_pseudo", "o5_md5_sample", "c19_loop", "t1_sliding", "t2_sessions",
    "c14_error_rows",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    took: dict[str, float] = {}
    known = queries()
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, d).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
