"""Mixing sources to target weights (operator 6), with DataFrame functions only.

Every document gets a hash-random key. The key's leading bits range-partition
each source into ``2 ** BUCKET_BITS`` buckets; the sizes of (source, bucket)
are added up in one aggregation, and running sums over the buckets of a source
are the distributed prefix sums. A source's budget is taken as whole epochs of
all its documents and a rest. Buckets that end before the rest are in, buckets
that begin after it are out, and only the one bucket the cut falls into is
sorted by key for the sums of its documents, so no source, however large, is
sorted or summed in one task. The document on the cut is in when at least half
of it lies before the cut: whole documents are taken, and a source's total
misses its target by half a document at most.

Targets fill up by weight: a source's target stops at ``max_epochs`` times its
size, and what it cannot take goes to the others by weight.

Defined results: a null source is a source of its own, in last place; a null
or empty text has size 0 and is never taken; the key
hashes id, size and ``tie``, null as a word, so rows without ids spread like
others; rows that agree in all three are counted one by one, in no order; empty input gives an empty result;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.common import drop_clashing, packed, read, unpacked, word_count, write_table

#: Leading bits of the 60-bit key that name a bucket.
KEY_BITS, BUCKET_BITS = 60, 12
#: Fixed values of the registered mix.
WEIGHTS, SHARE, MAX_EPOCHS = [5, 2, 1], 1.5, 2.0
ADDED = ["source_size", "target", "copies", "taken"]


def targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``target``.

    Sources in code-point order, null last, get the weights in turn. Filled up in the order of cap per weight, the
    first source whose cap the common level does not reach gives the level of all that remain."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1)).withColumn("cap", max_epochs * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (share * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level of the first source that stays below its cap; without one every source is at its cap
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level")))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.least(F.coalesce(level * F.col("w"), F.col("cap")), F.col("cap"))).select("source", "source_size", "target")


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", tie: str | None = None, weights: list[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """``docs`` with source_size, target, ``copies`` (how often the mix holds the row) and taken (copies times size).

    ``tie`` names a column that tells rows of equal id and size apart."""
    docs = drop_clashing(docs, ADDED)
    names = {"source": source, "size": size, "doc_id": doc_id, "tie": tie}
    rows = docs.select(packed(docs), *(F.col(f"`{c}`").alias(k) if c else F.lit("").alias(k) for k, c in names.items()))
    source, size, doc_id = "source", "size", "doc_id"
    told = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (doc_id, size, "tie")]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), told[0], F.lit(":"), told[1], F.lit(":"), told[2]))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    keyed = rows.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", KEY_BITS - BUCKET_BITS))

    sums = keyed.groupBy(F.col(source).alias("source"), "_bucket").agg(F.sum(size).alias("s"))
    goal = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("before", before).join(goal.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
    whole, cut = F.col("before") + F.col("s") <= F.col("rest"), (F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))
    plan = placed.groupBy(F.col("source").alias("_source")).agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")),
        F.coalesce(F.max(F.when(whole, F.col("_bucket"))), F.lit(-1)).alias("_whole_to"),
        F.coalesce(F.max(F.when(cut, F.col("_bucket"))), F.lit(-1)).alias("_cut"),
        F.coalesce(F.max(F.when(cut, F.col("before"))), F.lit(0)).alias("_before"),
    )
    plan = write_table(plan, "mix-plan").withColumnRenamed("source_size", "_source_size")  # one row a source, read by both branches

    joined = keyed.join(plan, F.col(source).eqNullSafe(F.col("_source")))
    clear = joined.filter(F.col("_bucket") != F.col("_cut")).withColumn("_more", (F.col("_bucket") <= F.col("_whole_to")).cast("long"))
    order = Window.partitionBy("_source").orderBy("_key", doc_id, size, "tie").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum(size).over(order)  # a source's rows in one bucket: a 4096th part of it
    on_cut = joined.filter(F.col("_bucket") == F.col("_cut")).withColumn("_more", (2 * upto - F.col(size) <= 2 * F.col("rest")).cast("long"))
    copies = F.when(F.col(size) > 0, F.col("epochs") + F.col("_more")).otherwise(0).cast("long")
    out = clear.unionByName(on_cut).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col(size))
    return out.select(*unpacked(docs), F.col("_source_size").alias("source_size"), "target", "copies", "taken")


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix holds it."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    slim = write_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("tie")), "mix-sizes")
    return mix(slim, tie="tie").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS k,
    coalesce(md5(text), 'null') AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap), cap) AS target FROM l),
p AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
