"""M3, M9: exact stratified splits by distributed ranks.

Each customer gets a 60-bit hash key. Within a class (a label value) rows are
ranked by key, and the parts of a split are runs of that order with exact
quotas: part j of a class with n rows ends at round(n * (share_0 + .. +
share_j)). So every part holds its share of every class to within a row, a row's
part does not depend on partitions or retries, and equal seeds give equal parts.

Nothing is sorted as a whole. Rows are counted by class and leading bits of the
key (``2 ** BUCKET_BITS`` buckets a class, added up before the shuffle); prefix
sums over these counts tell for each bucket between which ranks it lies. Rows
of a bucket that lies inside one part are done. Only buckets that a quota cuts
are ranked by key, one window a bucket.

A null label is a class of its own. Rows that agree in customer id are ordered
arbitrarily, and any order fills the quotas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS, BUCKET_BITS = 60, 12


def hash_key(seed: int, stream: int, customer: str = "customer_id") -> Column:
    """60 bits of md5 of id, seed and stream (what the key is drawn for)."""
    text = F.concat_ws("|", F.coalesce(F.col(customer).cast("string"), F.lit("")), F.lit(str(seed)), F.lit(str(stream)))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def with_parts(df: DataFrame, shares: list[float], seed: int, stream: int, label: str = "churn", name: str = "part",
               bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``df`` with ``name`` = 0 .. len(shares) - 1; the shares add up to 1."""
    df = df.drop(name)
    keyed = df.withColumn("_key", hash_key(seed, stream)).withColumn("_bucket", F.shiftright("_key", KEY_BITS - bucket_bits))
    counts = keyed.groupBy(F.col(label).alias("_label"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy("_label"))
    plan = counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_total", total)
    ends, done = [], 0.0
    for share in shares[:-1]:
        done += share
        ends.append(F.floor(F.lit(done) * F.col("_total") + F.lit(0.5)))

    def part_of(rank: Column, columns) -> Column:
        """The number of quotas at or before a rank (from 0)."""
        return sum((F.when(rank >= e, 1).otherwise(0) for e in columns), F.lit(0)).cast("int")

    plan = plan.select(
        "_label", "_b", (F.col("_end") - F.col("_n")).alias("_before"), F.array(*ends).alias("_quotas"),
        part_of(F.col("_end") - F.col("_n"), ends).alias("_first"), part_of(F.col("_end") - 1, ends).alias("_last"))
    # a row a class and bucket: classes times 2 ** bucket_bits, whatever the data
    joined = keyed.join(F.broadcast(plan), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    whole = joined.filter("_first = _last").withColumn(name, F.col("_first"))
    order = Window.partitionBy("_label", "_bucket").orderBy("_key", F.col("customer_id"))
    rank = F.col("_before") + F.row_number().over(order) - 1
    quotas = [F.col("_quotas")[i] for i in range(len(ends))]
    cut = joined.filter("_first <> _last").withColumn("_rank", rank).withColumn(name, part_of(F.col("_rank"), quotas))
    columns = [*df.columns, name]
    return whole.select(columns).unionByName(cut.select(columns))
