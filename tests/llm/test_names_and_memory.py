"""Callers' column names, bounded tables, and files of repeated tasks."""

import random
import zlib

import pyarrow as pa
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnscope.llm import bpe, common, host_rules, mixing, sharding, token_files
from tests.llm.test_operators import ids_bytes

NAMES = ["rest", "epochs", "_key", "_bucket", "_block", "_host", "_in", "_source", "tie", "a.b", "_of"]


def named(docs):
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    return docs


def held(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[n] for n in NAMES)) for r in df.collect())


def test_callers_columns_pass(spark, docs, tmp_path):
    own = named(docs)
    own.write.parquet(str(tmp_path / "d"))
    own = spark.read.parquet(str(tmp_path / "d"))
    want = held(own)
    assert held(mixing.mix(own.withColumn("size", F.coalesce(F.col("n_chars").cast("long"), F.lit(0))))) == want
    assert held(sharding.shuffle_to_shards(own, 3)) == held(sharding.shuffle_to_shards(own, 3, block_rows=1)) == want
    assert held(host_rules.judge(host_rules.features(own))) == want


def test_rows_without_ids_spread_over_buckets(spark):
    """A third of all rows without an id: no bucket of the mix holds more than a small part of them."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("size"), F.md5(F.col("id").cast("string")).alias("tie"))
    out = mixing.mix(rows, tie="tie").collect()
    plan = [p for p in out if p["doc_id"] is None]
    total = sum(r["size"] for r in out)
    assert len(plan) == 3000 and {r["copies"] for r in plan} == {1, 2} and abs(sum(r["taken"] for r in out) - 1.5 * total) <= 7


def test_tables_are_bounded_by_bytes():
    """Text without spaces, an entry a document, and many short words."""
    made = []
    table = bpe.Bounded(lambda k: made.append(k) or k * 2, 1_000_000)
    for k in range(20_000):
        assert table[f"w{k}"] == f"w{k}" * 2
        assert table.size <= 1_000_000
    assert len(table) < 10_000 and "x" * 5000 not in table and table["x" * 5000] and "x" * 5000 not in table
    codec = bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(1)
    for _ in range(60):
        codec.encode("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(20_000)))
    assert codec.chunks.size + codec.pieces.size < 1 << 20
    codec.encode("some words here")
    assert codec.chunks and bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN) and bpe.codec.cache_info().currsize
    list(common.released(lambda batches: batches, "bpe")(iter([1])))
    assert bpe.codec.cache_info().currsize
    list(common.released(lambda batches: batches, "another operator")(iter([1])))
    assert not bpe.codec.cache_info().currsize


def test_token_files_take_the_plain_call(spark, tmp_path):
    texts = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>. x", "<|endoftext|><|endoftext|> Café", "plain words, here!", "", None, "< |endoftext|>"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, want = 0, []
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(ids_bytes(ids))))
        start += len(ids)
    assert [tuple(r) for r in token_files.op3_token_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()] == want
    assert 49407 in tok.encode(texts[0], add_special_tokens=False).ids


def test_op3_on_whole_documents(spark, stored):
    """The query's four columns by the library's plain call on every document."""
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(stored[0] + "/documents.parquet").collect()
    start, want = 0, []
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(ids_bytes(ids))))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.op3_token_files(spark, stored[0]).collect()), key=lambda r: r[1])
    assert got == want


def test_a_task_that_writes_twice(spark, tmp_path):
    """Two attempts of one task leave their own files; the one that no index row names is removed."""
    folder = f"file://{tmp_path}/ids"
    for name in ("part-000000-1-x.zst", "part-000000-2-y.zst"):
        w = token_files.FrameWriter(folder, name, 3)
        w.add(ids_bytes([1, 2, 3]))
        if name.endswith("x.zst"):
            w.out.close()  # lost before its seek table
        else:
            w.close()
    index = spark.createDataFrame([(5, "part-000000-2-y.zst", 0, 3)], "doc_id long, file string, pos long, n_tokens long")
    token_files.remove_lost(index, folder)
    assert [p.name for p in (tmp_path / "ids").iterdir()] == ["part-000000-2-y.zst"]
    assert [bytes(r["ids"]) for r in token_files.read_documents(index, folder).collect()] == [ids_bytes([1, 2, 3])]


def test_batches_of_long_rows_are_small_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    long = spark.range(300).selectExpr("id", "repeat('x', 100000) AS text").coalesce(1)
    with common.stored_steps(spark):
        rows = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(rows) == 300 and max(rows) <= (4 << 20) // 100_000 + 1
