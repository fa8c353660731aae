"""Each operator against brute force, a round trip or its library, on nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnscope.llm import bpe, host_rules, jaccard_join, mixing, pseudonyms, quotes, registry, sharding, token_counts, token_files, topk

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def ids_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you today?"), (1, 1, "assistant", "> how are   YOU today?\nFine."), (1, 2, "user", "> > How are you today?\n> Fine.\n\nGood"),
        (1, 3, "user", "unrelated"), (1, 4, "user", "> never said\nok"), (2, 0, "user", "> Fine.\nother conversation"), (None, None, "user", None), (3, 0, "user", ""), (1, 3, "user", "unrelated"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("reply_to", F.lit("clash"))
    out = sorted(quotes.link_quotes(df).collect(), key=lambda r: (r["conv_id"] or -1, r["place"]))
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[1, 1]["reply_to"] == 0 and by[1, 1]["text"] == "Fine." and by[1, 1]["max_level"] == 1
    assert by[1, 2]["reply_to"] == 1 and by[1, 2]["n_passages"] == 2 and by[1, 2]["n_linked"] == 2 and by[1, 2]["thread"] == 0
    assert by[1, 4]["reply_to"] is None and by[1, 4]["n_passages"] == 1 and by[2, 0]["n_linked"] == 0
    assert [r["turn"] for r in out if r["conv_id"] == 1] == [0, 1, 2, 3, 3, 4] and by[None, None]["text"] is None
    assert [r["place"] for r in out if r["conv_id"] == 1] == list(range(6))
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_pseudonyms(spark, docs):
    key = b"test"
    out = pseudonyms.pseudonymise(docs.withColumn("N_pii", F.lit(1)), key)
    held = {r["doc_id"]: r for r in out.collect()}
    assert held[11]["n_pii"] == 3 and "4111" not in held[11]["text"] and held[4]["text"] is None
    assert all(r["n_pii"] == 0 for k, r in held.items() if k != 11)
    back = pseudonyms.restore(out.drop("n_pii"), key).select("doc_id", "text")
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.select("doc_id", "text").collect()))
    assert pseudonyms.pseudonymise(docs.limit(0), key).count() == 0


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"k")
    for size in (1, 2, 3, 10, 97, 1000):
        image = [f.permute(v, size, b"t") for v in range(size)]
        assert sorted(image) == list(range(size)) and [f.permute(w, size, b"t", True) for w in image] == list(range(size))
    for s in ("4041894974608795", "+1 (988) 555-2485", "42.144.35.254", "03/25/2024", "31.12.1999", "123-45-6789", "GB82 WEST 1234 5698 7654 32"):
        t, n = pseudonyms.pseudonymise_text(s, f)
        assert n == 1 and len(t) == len(s) and pseudonyms.pseudonymise_text(t, f, True)[0] == s
        assert re.sub(r"\d", "9", re.sub("[A-Z]", "A", t)) == re.sub(r"\d", "9", re.sub("[A-Z]", "A", s))
    for s in ("4111111111111112", "999.1.1.1", "2024-13-01", "version 2.0.", "666-12-3456"):
        assert pseudonyms.pseudonymise_text(s, f) == (s, 0)


def test_token_files(spark, stored, tmp_path):
    full, empty = stored
    path, folder = P.path("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    index = token_files.with_start(token_files.write_documents(spark.read.parquet(full + "/documents.parquet"), folder, path, plain_specials=True))
    rows = token_files.read_documents(index, folder).collect()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter((r["doc_id"], ids_bytes(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in spark.read.parquet(full + "/documents.parquet").collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in itertools.pairwise(ends))
    one = next(r for r in rows if r["doc_id"] == 8)
    reader = token_files.FrameReader(folder, one["file"])
    assert reader.ids(one["pos"], one["n_tokens"]) == bytes(one["ids"]) and reader.decompressed == 1
    file = tmp_path / "ids" / one["file"]
    raw = bytearray(file.read_bytes())
    raw[-13] ^= 1  # the last frame's checksum
    file.write_bytes(bytes(raw))
    reader = token_files.FrameReader(folder, one["file"])
    with pytest.raises(ValueError):
        reader._frame(len(reader.frames) - 1)
    assert registry.QUERIES["op3_token_files"](spark, empty).count() == 0


def brute_components(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, len(s), min(least[find(k)], default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_join(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(300)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 90, 150]))] + common * (g % 2)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))
    for most in (jaccard_join.FREQUENT, 400):
        got = jaccard_join.link_classes(df, most=most)
        assert Counter(map(tuple, got.collect())) == brute_components(rows)
    assert jaccard_join.link_classes(df.limit(0)).count() == 0


def test_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 3000):
        both = rng.integers(-(2**63), 2**63 - 1, size)
        for more in (0, 1, 30, 900):
            x, y = (np.union1d(both, rng.integers(-(2**63), 2**63 - 1, more)) for _ in range(2))
            unlike = sum(((a ^ b) % 2**64).bit_count() for a, b in zip(jaccard_join.parity(x), jaccard_join.parity(y)))
            assert unlike <= len(np.setxor1d(x, y))
            assert more < 30 or unlike > 0


def test_wide_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    assert jaccard_join.wide_parity(np.arange(jaccard_join.WIDE_FROM)) is None
    for size in (1025, 2040, 4090, 9000):
        both = rng.integers(-(2**63), 2**63 - 1, size)
        for more in (0, 1, 30, 900):
            x, y = (np.union1d(both, rng.integers(-(2**63), 2**63 - 1, k)) for k in (more, 2 * more))
            wide = [np.array(jaccard_join.wide_parity(s), np.int64) for s in (x, y)]
            assert all(64 * len(w) >= len(s) for w, s in zip(wide, (x, y)))
            unlike = jaccard_join.wide_unlike(*wide)
            assert unlike == jaccard_join.wide_unlike(*wide[::-1]) <= len(np.setxor1d(x, y))
            assert more < 30 or unlike > 0


def test_jaccard_join_of_large_sets(spark):
    """Long texts, near copies on both sides of the threshold and sets on both sides of WIDE_FROM."""
    rng = random.Random(9)
    rows = []
    for size in (1000, 1100, 2100, 3000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for k, changed in enumerate((0, size // 60, size // 40, size // 20, size // 8)):
            copy = list(base)
            for at in rng.sample(range(size), changed):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * size + k, " ".join(copy)))
    got = jaccard_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_sharding(spark, stored):
    full, empty = stored
    table = spark.read.parquet(full + "/documents.parquet").withColumn("Slot", F.lit(1))
    for rows_a_block in (65536, 2):
        out = sharding.shuffle_to_shards(table, 3, block_rows=rows_a_block)
        got = out.collect()
        shards = defaultdict(list)
        for r in got:
            shards[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(got) == table.count()
        assert sorted(map(str, out.collect())) == sorted(map(str, got))  # reruns agree
    assert registry.QUERIES["op5_sharding"](spark, empty).count() == 0


def test_matrix_margins_and_law():
    sizes = np.array([5, 0, 40, 7, 13])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cells = []
    for seed in range(400):
        matrix = np.array([sharding.matrix_row(starts, p, 4, seed) for p in range(5)])
        assert (matrix.sum(1) == sizes).all() and matrix.sum(0).tolist() == sharding.shard_sizes(65, 4)
        cells.append(matrix[2, 0])
    mean, var = 40 * 17 / 65, 40 * 17 / 65 * 48 / 65 * 25 / 64
    assert abs(np.mean(cells) - mean) < 5 * (var / 400) ** 0.5 and 0.75 < np.var(cells) / var < 1.3
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 250000) < 5 * (187500 / 300) ** 0.5 and 0.75 < np.var(big) / 187500 < 1.3


def test_mixing(spark, stored):
    full, empty = stored
    got = registry.QUERIES["op6_mixing"](spark, full)
    rows = got.collect()
    assert len(rows) == 14 and sorted(map(str, got.collect())) == sorted(map(str, rows))
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    per = {(r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in per) - 1.5 * sum(s for s, _ in per)) < 1e-6
    for s, t in per:
        own = [r for r in rows if (r["source_size"], r["target"]) == (s, t)]
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["size"] for r in own) / 2
    assert registry.QUERIES["op6_mixing"](spark, empty).count() == 0


def test_bpe(spark, docs, reference):
    out = bpe.encode(docs.withColumn("IDS", F.lit(1)), RANKS, P.PATTERN, offsets=True)
    for r in out.collect():
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        text = reference.decode_with_offsets(r["ids"])[1] if r["ids"] else []
        assert r["offsets"] == text
    back = bpe.decode_text(out.select("doc_id", "ids"), RANKS, P.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    rng, pieces = random.Random(3), ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "1", "!", "　", "\x85", "\x1c", "漢", "🙂", "́", "\0"]
    codec = bpe.codec(RANKS, P.PATTERN)
    for _ in range(3000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        ids = np.frombuffer(codec.encode(s), "<i4").tolist()
        assert ids == reference.encode_ordinary(s) and codec.decode(ids) == s.encode()
    cut = spark.createDataFrame([(reference.encode_ordinary("🙂")[:1],)], "ids array<int>")
    assert "�" in bpe.decode_text(cut, RANKS, P.PATTERN).first()[0]


def test_bpe_query(spark, stored, reference):
    full, empty = stored
    got = Counter(map(tuple, registry.QUERIES["op7_byte_bpe"](spark, full).collect()))
    want = []
    for r in spark.read.parquet(full + "/documents.parquet").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == Counter(want) and registry.QUERIES["op7_byte_bpe"](spark, empty).count() == 0


def test_token_counts(spark, stored, reference):
    full, empty = stored
    lengths = [len(reference.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(full + "/documents.parquet").collect()]
    hist = registry.QUERIES["op8_token_counts"](spark, full)
    for r in hist.collect():
        n = r["length"]
        assert tuple(r) == (n, lengths.count(n), n * lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
    for r in token_counts.at_limits(hist, [0, 10, 10**6]).collect():
        n = r["context_limit"]
        assert tuple(r) == (n, sum(x > n for x in lengths), sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert registry.QUERIES["op8_token_counts"](spark, empty).count() == 0


def test_host_rules(spark, stored):
    full, empty = stored
    rows = registry.QUERIES["op9_host_rules"](spark, full).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(full + "/documents.parquet").collect()]
    for doc_id, text in texts:
        words = (text or "").encode().split()
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        r = next(r for r in rows if r["doc_id"] == doc_id)
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(again))
        assert r["base_failed"] == (len(words) < 50 or 2 * len(again) > len(words))
    assert any(r["kept"] for r in rows) and not any(r["kept"] and r["base_failed"] for r in rows)
    assert host_rules.figures("a b\n\na b\n #$ é\n \n".encode()) == (6, 7, 2, 1, 0)
    hosts = spark.createDataFrame([("bad", True)] * 200 + [("good", False)] * 200 + [("few", True)] * 2 + [("bad", False)], "source string, base_failed boolean")
    assert {r["host"] for r in host_rules.host_rates(hosts).collect() if r["shrunk_rate"] >= host_rules.HOST_LIMIT} <= {"bad"}
    assert registry.QUERIES["op9_host_rules"](spark, empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for k in range(600)]
    rows += [(600 + k, rows[300][1]) for k in range(50)] + [(700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")]), (None, [1.0]), (800, []), (900, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    use = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in use:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i)[:10]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) == {i for i, _ in use if i % 100 == 0}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_pipeline(spark, stored, reference):
    import corpus_pipeline

    full, empty = stored
    table = [tuple(r) for r in spark.read.parquet(full + "/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = {1: table[0], **{d: (d, t, s) for d, t, s in table if d in (1, 7)}}
    rows = corpus_pipeline.run(spark, full).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(kept)
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(kept[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"])
    docs = spark.read.parquet(full + "/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, full).collect()} == {1, 2, 3, 7}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, full).collect()} == {1, 4, 5, 6, 7, 8, None, 11, 12, 13}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, full).columns == docs.columns
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert zlib.crc32(b"") == 0
