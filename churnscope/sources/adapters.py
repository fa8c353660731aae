"""Adapters from the star-schema test tables to transaction lines.

Both return the raw transaction shape (``customer_id, invoice, stock_code,
quantity, price, invoice_date[, country]``) that ``clean`` expects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: one invoice per order, returned lines cancelled.

    lineitem joins orders, part and supplier on their keys; the supplier's
    nation is the line's country. Only the columns used are read (Catalyst
    prunes the parquet scans); dimension joins are left to AQE, which
    broadcasts a side only when its measured size is under the threshold and
    otherwise keeps a shuffle join.
    """
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    od = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    sp = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
         .join(pt, li.l_partkey == pt.p_partkey)
         .join(sp, li.l_suppkey == sp.s_suppkey)
         .join(na, sp.s_nationkey == na.n_nationkey))
    # The invoice is built from the line's own order key (equal to the order's
    # under the join), so the cancelled-line predicate of ``clean`` refers to
    # lineitem columns only and Catalyst filters returned lines before the
    # lineitem/orders join and its shuffle.
    order_id = F.col("l_orderkey").cast("string")
    return j.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), order_id))
         .otherwise(order_id).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("n_name").alias("country"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as purchases: one line per event, error events cancelled, no country."""
    return events_to_transactions(load(spark, sf_dir, "events"))


def events_to_transactions(events: DataFrame) -> DataFrame:
    """Row-wise mapping of event rows (batch or streaming) to raw lines."""
    ev = events.select("event_id", "user_id", "ts", "event_type", "value")
    eid = F.col("event_id").cast("string")
    return ev.select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("C"), eid))
         .otherwise(eid).alias("invoice"),
        F.col("event_type").alias("stock_code"),
        F.lit(1).alias("quantity"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.col("ts").alias("invoice_date"),
    )


ADAPTERS = {"orders": from_orders, "events": from_events}
