"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 5).

Rows sit in the input's partitions. How many rows of partition p go to shard s
is drawn from the law that a uniform shuffle gives these counts: a
multivariate hypergeometric matrix with the partitions' and the shards' sizes
as margins. It is drawn by halving: the rows of a range of partitions are
split between its two halves, shard by shard, each node of this tree with a
generator of its own. A task follows the path to its own partition, so the
matrix exists nowhere as a whole; what tasks share is one count a partition.
Each task deals a random permutation of its exact counts to its rows, the rows
are exchanged once, and each shard is permuted again: its rows go to random
blocks of bounded size, each sorted by a random key, and a row's slot is its
place after the blocks before.

The law is ``rows``: shard sizes differ by one row at most. Draws depend on
the seed and on the partitions' sizes alone, so a repeated task deals as it
did before; the input must be a stored table, whose partitions and row order
stay (a task that finds another number of rows than was counted fails).

Defined results: null ids and texts are rows like any other; repeated rows are
dealt one by one; empty input gives an empty result; input columns named like
an output column are replaced. Equal texts are not kept together: exact row
counts and whole groups of any size exclude each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.common import drop_clashing, packed, read, released, shuffle_width, unpacked

#: Rows a block of a shard holds on average, at most.
BLOCK_ROWS = 65_536
#: NumPy draws from populations below this size.
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad``. Large populations: inversion of the distribution around its mode."""
    if good + bad < NUMPY_LIMIT or min(good, bad, drawn) == 0:
        return int(rng.hypergeometric(good, bad, drawn)) if min(good, drawn) else 0
    total = good + bad
    mean = drawn * good / total
    sd = math.sqrt(mean * (bad / total) * (1 - drawn / total)) + 1
    low, high = max(0, drawn - bad, int(mean - 12 * sd)), min(good, drawn, int(mean + 12 * sd) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def split(rng: np.random.Generator, room: list[int], drawn: int) -> list[int]:
    """How ``drawn`` rows fall on shards with this much room: a multivariate hypergeometric draw."""
    got, rest = [], sum(room)
    for r in room:
        rest -= r
        got.append(hypergeometric(rng, r, rest, drawn))
        drawn -= got[-1]
    return got


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def matrix_row(starts: np.ndarray, p: int, shards: int, seed: int) -> list[int]:
    """Counts of partition ``p`` by shard; ``starts`` are the running sums of the partitions' rows, from 0."""
    low, high, room = 0, len(starts) - 1, shard_sizes(int(starts[-1]), shards)
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, 0, low, high]), room, int(starts[mid] - starts[low]))
        if p < mid:
            high, room = mid, left
        else:
            low, room = mid, [r - x for r, x in zip(room, left)]
    return room


def deal(starts: np.ndarray, p: int, shards: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, block and random key of each row of partition ``p``."""
    rng = np.random.default_rng([seed, 1, p])
    labels = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(starts, p, shards, seed))
    rng.shuffle(labels)
    return labels, rng.integers(0, blocks, len(labels), dtype=np.int32), rng.integers(0, 2**63 - 1, len(labels))


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (a stored table) with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard)."""
    from pyspark import TaskContext

    docs = drop_clashing(docs, ["shard", "slot"])
    spark = docs.sparkSession
    # one number a partition comes to the driver
    counted = {r["p"]: r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    sizes = [counted.get(p, 0) for p in range(max(counted, default=-1) + 1)]
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    blocks = max(1, -(-int(starts[-1]) // (shards * block_rows)))
    rows = docs.select(packed(docs))
    out = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in (("shard", T.IntegerType()), ("_block", T.IntegerType()), ("_key", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        dealt = deal(starts, p, shards, blocks, seed) if p < len(sizes) else (np.empty(0, np.int32),) * 3
        for batch in batches:
            part = [x[at : at + batch.num_rows] for x in dealt]
            at += batch.num_rows
            if at > len(dealt[0]):
                break
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, part)], names=[f.name for f in out])
        if at != len(dealt[0]):
            raise RuntimeError(f"partition {p} had {len(dealt[0])} rows when it was counted; the input must be a stored table")

    exchanged = rows.mapInArrow(released(run), out).repartition(shuffle_width(spark), "shard", "_block")
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_key")) - 1
    placed = exchanged.withColumn("_place", place.cast("long"))
    if blocks == 1:
        return placed.select(*unpacked(docs), "shard", F.col("_place").alias("slot"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                labels, block, _ = deal(starts, p, shards, blocks, seed)
                cells, n = np.unique(labels.astype(np.int64) * blocks + block, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((cells // blocks).astype(np.int32), (cells % blocks).astype(np.int32), n)], names=["s", "b", "n"])

    # the draws alone give the blocks' sizes: no second pass over the data
    cells = spark.range(len(sizes)).mapInArrow(count, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select(F.col("s").alias("_s"), F.col("b").alias("_b"), before.alias("_before"))
    joined = placed.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.select(*unpacked(docs), "shard", (F.col("_before") + F.col("_place")).alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One directory a shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_to_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
