"""Training-data pipeline over ``documents``: five of the operators of ``churnscope.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared checkpoint folder and rereads it.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import bpe, host_rules, jaccard_join, mixing, pseudonyms
from churnscope.llm.common import SMALL_BATCHES, WORD, read, word_count, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this percentage of their shingles of so many words; op4's query keeps its own values.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches that stay small on both sides, by rows and by bytes."""
    for name, value in SMALL_BATCHES.items():
        spark.conf.set(name, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Host-level quality rules: documents that fail, or whose host is rejected, go."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    measured = host_rules.features(docs.withColumn("_text", F.col("text")), text="_text")
    figures = write_table(measured.select("source", *host_rules.FIGURES), "host-figures")
    hosts = host_rules.rejected_hosts(figures, rules=host_rules.RULES)
    good = measured.filter(~F.col("base_failed"))
    return good.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of linked documents one row stays, that with the smallest id.

    A row's key is a hash of its id and text, so rows of one id and different texts are told apart; keys decide among
    rows of one id, and null ids come last. Rows without words link with nothing and all stay.

    All this is found on keys and ids alone. Whole rows are dealt by key only where they may go, or their key is there
    more than once; the others stay where they are."""
    small_batches(spark)
    docs = docs.select(COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text")).withColumn("_worded", F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    worded = docs.filter("_worded")
    linked = jaccard_join.link_classes(worded.select(F.col("_key").alias("doc_id"), "text"), width=NEAR_WIDTH, percent=NEAR_PERCENT)
    classes = linked.groupBy(F.col("doc_id").alias("_key"), F.col("component_id").alias("_class")).agg(F.count("*").alias("_rows"))
    ids = write_table(worded.select("_key", "doc_id").distinct().join(classes, "_key"), "near-ids")
    first = write_table(ids.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key")).select("_key").distinct(), "near-first")
    times = ids.groupBy("_key").agg(F.sum("_rows").alias("_rows")).join(first.withColumn("_first", F.lit(True)), "_key", "left")
    unsure = write_table(times.filter("_first is null or _rows > 1").select(F.col("_key").alias("_id")), "near-unsure")
    docs = docs.withColumn("_unsure", F.col("_worded") & jaccard_join.may_be(unsure)(F.col("_key")))
    kept = docs.filter("_unsure").join(first, "_key", "left_semi").dropDuplicates(["_key", "doc_id"])  # the join has dealt them by key already
    return kept.select(COLUMNS).unionByName(docs.filter("not _unsure").select(COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Format-preserving pseudonyms in place of personal data; every document stays."""
    small_batches(spark)
    return pseudonyms.pseudonymise(docs.select(COLUMNS), pseudonyms.DEMO_KEY).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing by source: each document as often as the mix holds it."""
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    return mixing.repeat(mixing.mix(sized, tie="text"), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document's text."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "source", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pii),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Pseudonyms, hashes of sets and BPE have no SQL form; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
