"""Exact length histogram of encoded documents (operator 8).

Documents are encoded once; only their lengths are kept. One aggregation gives
the number of documents of each length (partial sums before the shuffle, one
row per distinct length after it). Suffix sums over that histogram answer, for
every context limit at once, how many documents and tokens lie beyond it and
how many tokens remain when every document is cut at the limit. The sums run
over blocks of lengths first, so no task takes the whole histogram.

Defined results: a null or empty text has length 0; no documents give an empty
histogram; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.bpe import codec, slices
from churnscope.llm.common import read, released, write_table

#: Lengths per block of the suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``length`` of each document in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            found = [len(bpe.encode(t or "")) // 4 for texts in slices(batch.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(released(run, "bpe"), "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct length: documents and tokens of it, of it and beyond, and the total when all are cut at it."""
    counts = write_table(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "length-counts")  # read twice
    counts = counts.withColumn("n_tokens", F.col("n_docs") * F.col("length")).withColumn("block", F.floor(F.col("length") / BLOCK))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"), F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before_t"))
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(blocks, "block").select(
        "length", "n_docs", "n_tokens",
        (F.sum("n_docs").over(down) + F.col("later_d")).alias("docs_from"),
        (F.sum("n_tokens").over(down) + F.col("later_t")).alias("tokens_from"),
        (F.sum("n_tokens").over(up) + F.coalesce("before_t", F.lit(0))).alias("tokens_to"),
    )
    return sums.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("tokens_to") + F.col("length") * (F.col("docs_from") - F.col("n_docs"))).alias("truncated_total"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits: documents beyond the limit, tokens kept and tokens cut off."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # one pass over the histogram per limit list: the list is the caller's, a few values
    rows = hist.crossJoin(F.broadcast(asked))
    beyond = F.col("length") > F.col("context_limit")
    return rows.groupBy("context_limit").agg(
        F.sum(F.when(beyond, F.col("n_docs")).otherwise(0)).alias("docs_beyond"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
        F.sum(F.greatest(F.col("length") - F.col("context_limit"), F.lit(0)) * F.col("n_docs")).alias("tokens_cut"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents does not exceed (no row if there are none)."""
    total = hist.agg(F.sum("n_docs").alias("total"))
    short = hist.crossJoin(F.broadcast(total)).filter(F.col("total") - F.col("docs_from") + F.col("n_docs") >= F.col("total") * F.lit(float(q)))
    return short.agg(F.min("length").alias("length")).filter("length is not null")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return histogram(lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
