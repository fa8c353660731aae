"""Bench: headline queries on $BENCH_SF_DIR (default sf0.1), local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully executed (noop write of every row). Shared intermediate
tables (clean lines, customer features, scores) are built first and timed as
their own entries, as a pipeline would build them once.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "S6_P1_P6_clean_orders",
    "F21_customer_features",
    "F22_baseline_features",
    "F18_F19_labelled_features",
    "A16_cohort_retention",
    "C1_C3_customer_risk_scores",
    "R1_loss_distribution",
    "R2_loss_stats",
    "R3_stress_test",
    "M10_binary_metrics",
    "A6_tier_summary",
    "A13_value_risk_quadrants",
    "A14_feature_medians",
    "W6_page_customers",
    "F21_customer_features_events",
    "S1_read_transactions_csv",
    "ST_stream_ingest_events",
    "M8_M10_model_metrics_40_rounds",
    "M13_contributions",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from churnscope import queries as Q
    from churnscope.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus), "churnscope-bench")
    times = {}

    def timed(name, fn):
        t = time.time()
        df = fn()
        df.write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t, 3)

    timed("prep_tx_orders", lambda: Q.tx_of(spark, sf_dir, "orders"))
    timed("prep_customer_table", lambda: Q.cust_of(spark, sf_dir, "orders"))
    timed("prep_scored_table", lambda: Q.scored_of(spark, sf_dir, "orders"))
    for name in HEADLINE:
        timed(name, lambda n=name: Q.REGISTRY[n](spark, sf_dir))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
