"""Skew: one customer holding a third of all lines.

Checks that features stay exact, and that no exchange partitions raw line
rows by customer alone (every customer-keyed shuffle sits above a partial
aggregation, so a hot customer is never one task's whole input).
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from churnscope import oracle_sql as O
from churnscope.operators import features as FE
from churnscope.operators.clean import clean
from churnscope.sources.adapters import from_orders
from tests.conftest import SF001


def _skewed(spark):
    raw = from_orders(spark, SF001)
    n = raw.count()
    hot = raw.limit(1).select("customer_id").first()[0]
    # copies of other customers' lines re-keyed to the hot customer, with
    # their own invoices, until the hot customer holds about a third
    extra = (raw.filter(F.col("customer_id") != hot).limit(n // 2)
             .withColumn("customer_id", F.lit(hot))
             .withColumn("invoice", F.concat(F.lit("H"), F.col("invoice"))))
    return raw.unionByName(extra), hot


def _shuffles_on_raw_customer_rows(plan) -> list:
    bad = []

    def walk(node):
        name = node.nodeName()
        if name == "Exchange" or "ShuffleExchange" in node.getClass().getSimpleName():
            part = node.outputPartitioning().toString()
            if part.startswith("hashpartitioning(customer_id") and part.count("#") == 1:
                child = node.children().apply(0)
                passthrough = ("WholeStageCodegen", "InputAdapter", "Filter", "Project", "ColumnarToRow")
                while child.nodeName().startswith(passthrough) and child.children().size() > 0:
                    child = child.children().apply(0)
                # Allowed inputs: an aggregation, or a scan of the written
                # (customer, day) aggregate table.
                ok = "Aggregate" in child.nodeName() or (
                    "Scan" in child.nodeName() and "daily_totals" in child.toString())
                if not ok:
                    bad.append((part, child.nodeName()))
        ch = node.children()
        for i in range(ch.size()):
            walk(ch.apply(i))

    walk(plan)
    return bad


def test_hot_customer_features_exact(spark):
    raw, hot = _skewed(spark)
    tx = clean(raw).cache()
    share = tx.filter(F.col("customer_id") == hot).count() / tx.count()
    assert share > 0.3
    got = {r["customer_id"]: r for r in FE.customer_features(tx).collect()}
    con = duckdb.connect()
    con.register("tx_raw", tx.withColumn("price", F.col("price")).toPandas())
    sql = O.features_ctes("orders")
    sql = sql.split("refd AS", 1)[1]
    exp = con.execute("WITH tx AS (SELECT * FROM tx_raw), refd AS" + sql + " SELECT * FROM feat").df()
    exp = {r["customer_id"]: r for r in exp.to_dict("records")}
    assert got.keys() == exp.keys()
    for cid in (hot,) + tuple(list(exp)[:20]):
        for c in O.FEATURE_LONGS + O.FEATURE_DOUBLES:
            assert got[cid][c] == pytest.approx(exp[cid][c], rel=1e-9, abs=1e-9), (cid, c)


def test_no_customer_keyed_shuffle_of_raw_lines(spark):
    tx = clean(from_orders(spark, SF001))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (FE.customer_features(tx), FE.baseline_features(tx)):
            plan = df._jdf.queryExecution().executedPlan()
            assert _shuffles_on_raw_customer_rows(plan) == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_plan_check_flags_raw_customer_shuffle(spark):
    tx = clean(from_orders(spark, SF001))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bad = tx.repartition("customer_id").groupBy("customer_id", "invoice").count()
        assert _shuffles_on_raw_customer_rows(bad._jdf.queryExecution().executedPlan()) != []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_returned_lines_filtered_before_order_join(spark):
    """The cancelled-line predicate is evaluated on lineitem rows before they
    meet orders (and before any exchange), never as a join condition."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clean(from_orders(spark, SF001))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {"join_residual": [], "below_exchange": False}

    def walk(node, under_exchange):
        name = node.nodeName()
        text = node.verboseString(1000)
        if "Join" in name and "StartsWith" in text:
            found["join_residual"].append(name)
        if name == "Filter" and "StartsWith" in text and under_exchange:
            found["below_exchange"] = True
        here = under_exchange or name == "Exchange"
        ch = node.children()
        for i in range(ch.size()):
            walk(ch.apply(i), here)

    walk(plan, False)
    assert found["join_residual"] == []
    assert found["below_exchange"]


def test_daily_aggregate_read_once(spark):
    """Totals, gaps and trend share one scan and one exchange of the written
    (customer, day) aggregate."""
    from churnscope import queries as Q
    tx = Q.tx_of(spark, SF001)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = FE.customer_features(tx)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = []

    def walk(node):
        if "Scan" in node.nodeName() and "daily_totals" in node.toString():
            scans.append(node)
        ch = node.children()
        for i in range(ch.size()):
            walk(ch.apply(i))

    walk(plan)
    assert len(scans) == 1


def test_cohort_pairs_aggregated_once(spark):
    """Retention ranks cohorts and offsets over the aggregated cohort table:
    the per-customer cohort window over customer-month pairs runs once."""
    from churnscope import queries as Q
    from churnscope.operators import cohorts as CO
    tx, cust = Q.tx_of(spark, SF001), Q.cust_of(spark, SF001)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = CO.cohort_retention(tx, cust)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("min(month") == 1
    assert "ReusedExchange" not in plan


def test_month_change_span_without_join(spark):
    """W2 builds the zero-filled month span inside one window: no join."""
    from churnscope import queries as Q
    tx = Q.tx_of(spark, SF001)
    df = FE.monthly_pct_change(FE.monthly_spend(tx))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Window [") == 1
