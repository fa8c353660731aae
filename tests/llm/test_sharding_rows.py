"""Every column of the sharding query against a plain walk over the rows it was given."""
import zlib
from collections import Counter, defaultdict

from churnscope.llm import sharding


def test_op5_rows_as_plain(spark, docs, stored):
    got = sharding.op5_sharding(spark, stored[0]).collect()
    raw = lambda text: (text or "").encode()
    want = Counter((r["doc_id"], len(raw(r["text"])) + 16, zlib.crc32(raw(r["text"])), "rows", None) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    counts = [len(slots.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_blocks_keep_rows_and_counts(spark, tmp_path):
    """Many blocks a shard: the same rows, counts at most one apart, gapless slots."""
    spark.range(997).selectExpr("id AS doc_id", "repeat('x', CAST(id % 9 AS INT)) AS text").repartition(5).write.parquet(str(tmp_path / "d"))
    got = sharding.shuffle_to_shards(spark.read.parquet(str(tmp_path / "d")), 7, block_rows=10).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(997))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
