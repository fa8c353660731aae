"""Any page of the customers by probability, without an offset.

The order index is a stored copy of the customers, range-dealt by the sort key
(probability from the highest, then id) into buckets; the id in the key splits a
probability that many customers share. A page is found from one count a bucket
of the matching customers: prefix sums of the counts name the bucket or buckets
that hold the page's ranks, and only those are read and ranked. No plan sorts
all customers or skips rows, whatever the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.operators.summaries import PAGE_COLUMNS, search_customers, select_existing
from churnscope.session import write_table

ORDER = (("churn_prob", "desc"), ("customer_id", "asc"))


def _order():
    return [getattr(F.col(c), way)() for c, way in ORDER]


def order_index(cust: DataFrame, buckets: int = None) -> DataFrame:
    """Stored: ``cust`` with ``_bucket``, ascending in the page order; files are sorted, so a bucket's rows lie together."""
    n = buckets or max(8, int(cust.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cust.repartitionByRange(n, *_order()).sortWithinPartitions(*_order())
    return write_table(dealt.withColumn("_bucket", F.spark_partition_id()), "order-index")


def page_of(index: DataFrame, page: int = 1, limit: int = 20, search: str = None, tier: str = None) -> DataFrame:
    """The page's rows with the total matching count; ``index`` is from ``order_index``."""
    matching = search_customers(index, search, tier)
    # a row a bucket comes to the driver
    counts = sorted((r["_bucket"], r["n"]) for r in matching.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    first, last = (page - 1) * limit, page * limit  # ranks from 0, the last one excluded
    held, before = [], 0
    for bucket, n in counts:
        if before < last and before + n > first:
            held.append((bucket, before))
        before += n
    columns = [c for c in PAGE_COLUMNS if c in index.columns]
    if not held:
        return select_existing(matching.filter(F.lit(False)), columns).withColumn("total", F.lit(total).cast("bigint"))
    rows = matching.filter(F.col("_bucket").isin([b for b, _ in held]))
    start = F.coalesce(*(F.when(F.col("_bucket") == b, F.lit(k)) for b, k in held))
    rank = start + F.row_number().over(Window.partitionBy("_bucket").orderBy(*_order())) - 1
    rows = rows.withColumn("_rank", rank).filter((F.col("_rank") >= first) & (F.col("_rank") < last))
    return select_existing(rows, columns).withColumn("total", F.lit(total).cast("bigint"))
