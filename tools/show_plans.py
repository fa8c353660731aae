"""Print the physical plans of the heavy operators (no Spark UI needed).

Usage: python tools/show_plans.py [sf_dir] [--full]
For each operator: shuffle exchanges, broadcasts, windows and file scans in
the executed plan (AQE off, so the static plan is shown), and with --full the
formatted plan with PushedFilters / ReadSchema per scan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from churnscope import queries as Q
    from churnscope.operators import cohorts as CO
    from churnscope.operators import features as FE
    from churnscope.operators import metrics as ME
    from churnscope.operators import portfolio as PF
    from churnscope.session import get_session

    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = get_session()
    tx, cust, scored = Q.tx_of(spark, sf), Q.cust_of(spark, sf), Q.scored_of(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ops = {
        "F21 customer_features": lambda: FE.customer_features(tx),
        "A16 cohort_retention": lambda: CO.cohort_retention(tx, cust),
        "R1 loss_distribution": lambda: PF.loss_distribution(scored, 10000),
        "R3 stress_test": lambda: PF.stress_test(scored, PF.loss_distribution(scored, 100).agg({"loss": "avg"}).scalar()),
        "M10 binary_metrics": lambda: ME.binary_metrics(Q.metric_fixture(spark, sf), "churn", "p"),
    }
    for name, build in ops.items():
        df = build()
        p = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {name}: shuffles={len(re.findall(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin', p))} "
              f"broadcasts={p.count('BroadcastExchange')} windows={p.count('Window [')} "
              f"scans={p.count('FileScan parquet')} generate={p.count('Generate ')}")
        if "--full" in sys.argv:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
