"""Exact top-k search by inner product with norm buckets (operator 10).

Vectors are range-partitioned by length (ties by id, so equal vectors spread)
and packed into buckets of similar length, longest first. Queries are packed
into blocks. Buckets and query blocks meet in bounded cells (some buckets, some
query blocks), the block form of comparing a stated query set with all rows.
In a cell each query keeps its k best scores so far; for each bucket the k-th
best and the two lengths give the cosine a vector of the bucket must reach.
Beyond 1 the bucket is skipped; at a high cosine the query's largest
coordinates bound which vectors can reach it (coordinate pruning); otherwise
the vectors are cut by length (length pruning). What remains is verified by
exact integer products. A last window keeps the k best of all cells.

Defined results: vectors that are null, hold null or non-finite components, or
have no id take no part; a query is never matched with rows of its own id;
repeated rows are candidates each and queries each; vectors of unequal length
are compared as if padded with zeros; scores beyond 63 bits raise an error;
no queries or no candidates give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.common import read, shuffle_width, write_table

#: Vectors in a bucket and queries in a block at most; both are also cut at PACK_BYTES.
BUCKET, QUERY_BLOCK, PACK_BYTES = 4096, 512, 4 << 20
#: A bucket ends where lengths fall below this share of its longest, once it has LEAST_BUCKET vectors.
SIMILAR, LEAST_BUCKET = 0.9, 256
#: Buckets and query blocks in a cell.
CELL_BUCKETS, CELL_BLOCKS = 4, 8
#: From this cosine on coordinates are checked, FOCUS of them.
HIGH_COSINE, FOCUS = 0.8, 3
SLACK = 1e-9

PACK = "uid long, longest double, n int, dim int, ids binary, vectors binary"


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v (integer components) and length of the rows that take part."""
    x = F.col(vector)
    whole = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(scale * c.cast("double")))
    out = vectors.filter(whole).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def packed(rows: DataFrame, most: int, by_length: bool) -> DataFrame:
    """Rows packed in order of length, longest first: ids and a matrix of integers a pack."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            dim = max(len(v) for _, v, _ in held)
            matrix = np.zeros((len(held), dim), np.int64)
            for k, (_, v, _) in enumerate(held):
                matrix[k, : len(v)] = v
            values = [[uid], [held[0][2]], [len(held)], [dim], [np.array([i for i, _, _ in held], np.int64).tobytes()], [matrix.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["uid", "longest", "n", "dim", "ids", "vectors"])

        for batch in batches:
            ids, lengths, column = batch.column("vec_id").to_pylist(), batch.column("length").to_pylist(), batch.column("v")
            for i, (vec_id, length) in enumerate(zip(ids, lengths)):
                v = column[i].values.to_numpy(zero_copy_only=False)
                if held and (len(held) >= most or size + v.nbytes > PACK_BYTES or (by_length and len(held) >= LEAST_BUCKET and length < SIMILAR * held[0][2])):
                    yield pack()
                    uid, held, size = uid + 1, [], 0
                held.append((vec_id, v, length))
                size += v.nbytes
        if held:
            yield pack()

    # the id keeps vectors of one length apart, so a common vector is not one partition
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    return ordered.mapInArrow(run, PACK)


class Best:
    """The k best candidates of each query of a block so far: higher score first, then smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = queries, ids, k
        self.length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score

    def offer(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.floor[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        ids, scores = np.concatenate([self.found[i][0], ids[keep]]), np.concatenate([self.found[i][1], scores[keep]])
        if len(ids) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[i] = scores[order[-1]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise OverflowError("an inner product may not fit in 63 bits")


def search(best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Offers every vector of a bucket (longest first) that can reach a query's k best."""
    dim = max(best.q.shape[1], vectors.shape[1])
    q, vectors = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (best.q, vectors))
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    reach = best.length * lengths[0] * (1 + SLACK)
    cosine = np.where(best.floor <= 0, -1.0, np.divide(best.floor, reach, out=np.full(len(reach), np.inf), where=reach > 0))
    open_ = (cosine <= 1) | (best.floor <= 0)
    by_coordinate = open_ & (cosine >= HIGH_COSINE)
    unit = vectors / np.maximum(lengths, 1e-300)[:, None] if by_coordinate.any() else None
    for i in np.flatnonzero(by_coordinate):
        # a unit vector at this cosine or a higher one lies within a band around the query on every coordinate
        need = np.minimum(1.0, best.floor[i] / np.maximum(best.length[i] * lengths, 1e-300)) * (1 - SLACK)
        near = best.length[i] * lengths * (1 + SLACK) >= best.floor[i]
        u = q[i] / best.length[i]
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            band = np.sqrt(np.maximum(0.0, 1 - need**2) * max(0.0, 1 - u[f] ** 2)) + SLACK
            near &= np.abs(unit[:, f] - u[f] * need) <= band + np.abs(u[f]) * (1 - need)
        if near.any():
            best.offer(i, ids[near], products(q[i : i + 1], vectors[near])[0])
    by_length = np.flatnonzero(open_ & ~by_coordinate)
    if len(by_length):
        shortest = np.where(best.floor[by_length] > 0, best.floor[by_length] / np.maximum(best.length[by_length], 1e-300) * (1 - SLACK), 0)
        upto = np.searchsorted(-lengths, -shortest, side="right")
        scores = products(q[by_length], vectors[: upto.max()])
        for row, i, n in zip(scores, by_length, upto):
            best.offer(i, ids[:n], row[:n])


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products, ties to the smaller id."""
    rows = usable(vectors, vec_id, vector, scale)
    buckets = write_table(packed(rows, BUCKET, True), "norm-buckets")
    blocks = write_table(packed(rows.filter(is_query), QUERY_BLOCK, False), "query-blocks")
    # cells of some buckets and some query blocks; a cell's buckets come from all lengths, so each has long ones first
    chunks, groups = (max(1, -(-df.count() // n)) for df, n in ((buckets, CELL_BUCKETS), (blocks, CELL_BLOCKS)))
    left = buckets.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("long")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["dim"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        held = sorted(a.to_pylist(), key=lambda r: -r["longest"])
        out: dict[str, list] = {c: [] for c in ("uid", "query_id", "vec_id", "score")}
        for block in b.to_pylist():
            ids, q = arrays(block)
            best = Best(q, ids, k)
            for bucket in held:
                search(best, *arrays(bucket))
            for n, (found, scores) in enumerate(best.found):
                out["uid"] += [(block["uid"] << 10) + n] * len(found)
                out["query_id"] += [int(ids[n])] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    scored = left.groupBy("chunk", "grp").cogroup(right.groupBy("chunk", "grp")).applyInArrow(run, "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
