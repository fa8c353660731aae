"""Monthly retention cohorts.

A customer's cohort is the calendar month of their first purchase; the
cohort index of a purchase is the number of months since then. Work is done
on distinct (customer, month) pairs, at most one row per active month per
customer, so neither the line count nor a very large customer affects the
window sizes. The cohort x index tables are bounded by (months in data)^2;
the global rankings of W5 run over them, not over customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.operators.features import month_index


def active_months(tx: DataFrame, cust: DataFrame = None) -> DataFrame:
    """Distinct (customer, month) pairs; J2: restricted to ``cust`` keys."""
    am = tx.select("customer_id", month_index(F.col("ts")).alias("month")).distinct()
    if cust is not None:
        am = am.join(cust.select("customer_id"), "customer_id", "left_semi")
    return am


def with_cohort_month(am: DataFrame) -> DataFrame:
    """First purchase month of the customer on every row."""
    w = Window.partitionBy("customer_id")
    return am.withColumn("cohort", F.min("month").over(w))


def cohort_counts(tx: DataFrame, cust: DataFrame = None) -> DataFrame:
    """Distinct customers per (cohort month, months since cohort)."""
    am = with_cohort_month(active_months(tx, cust))
    return (am.groupBy("cohort", (F.col("month") - F.col("cohort")).alias("cohort_index"))
            .agg(F.count(F.lit(1)).alias("customers")))


def month_label(m) -> F.Column:
    """Month index back to a ``yyyy-MM`` label."""
    y = F.floor(m / 12).cast("int")
    mm = (m - y * 12 + 1).cast("int")
    return F.format_string("%04d-%02d", y, mm)


def cohort_retention(tx: DataFrame, cust: DataFrame = None, k: int = 12) -> DataFrame:
    """Retention rate (customers / cohort size, half-even to 3 places) for
    the first ``k`` cohorts present and the first ``k`` month offsets present.

    J8: the cohort size is the index-0 count, spread over the cohort's rows
    with a window. Columns: cohort_month, cohort_index, customers, rate.
    """
    cc = cohort_counts(tx, cust)
    by_cohort = Window.partitionBy("cohort")
    cc = cc.withColumn("size", F.max(F.when(F.col("cohort_index") == 0, F.col("customers")))
                       .over(by_cohort))
    # Dense ranks of the cohorts and offsets present, taken over the
    # cohort x index rows themselves (at most (months in data)^2 rows, so one
    # window partition holds them). The customer-month pairs are aggregated
    # once; no second branch re-reads them to list the keys.
    top = (cc.withColumn("cohort_rank", F.dense_rank().over(Window.orderBy("cohort")))
           .withColumn("index_rank", F.dense_rank().over(Window.orderBy("cohort_index")))
           .filter((F.col("cohort_rank") <= k) & (F.col("index_rank") <= k)))
    rate = F.bround(F.col("customers").cast("double") / F.col("size").cast("double"), 3)
    return top.select(
        month_label(F.col("cohort")).alias("cohort_month"),
        F.col("cohort_index").cast("int").alias("cohort_index"),
        F.col("customers").cast("bigint").alias("customers"),
        rate.alias("rate"),
    )


def cohort_pivot(retention: DataFrame) -> DataFrame:
    """Wide table, one row per cohort, ``Month c`` columns holding the
    rate x 100 rounded (half-even) to 1 place; absent cells stay null.

    The offsets (at most ``k``) are looked up from the data by ``pivot``.
    """
    pct = F.bround(F.col("rate") * 100, 1)
    wide = (retention.groupBy("cohort_month").pivot("cohort_index").agg(F.first(pct)))
    return wide.withColumnsRenamed({c: f"{C.COHORT_COLUMN_PREFIX}{c}" for c in wide.columns
                                    if c != "cohort_month"})
