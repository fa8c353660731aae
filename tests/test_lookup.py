"""Search and lookup on stored indexes against full scans, and running sums over buckets of buckets."""

import random

import pytest
from pyspark.sql import functions as F

from churnscope.operators import lookup as K
from churnscope.operators import metrics as M
from churnscope.operators.summaries import search_customers

IDS = [f"{random.Random(k).randrange(10 ** 6)}" for k in range(400)] + ["AbC-12.5", "abc-12x5", "Çabc", "K123", "a", "", None, "1.23", "12+3", "140", "140"]


@pytest.fixture(scope="module")
def cust(spark):
    return spark.createDataFrame([(v, ["High Risk", "Low Risk"][k % 2], k) for k, v in enumerate(IDS)],
                                 "customer_id string, risk_tier string, n int").cache()


def ns(df):
    return sorted(r["n"] for r in df.collect())


def test_search_equals_the_scan(spark, cust):
    index = K.gram_index(cust)
    rnd = random.Random(3)
    some = [v for v in IDS if v and v.isascii() and len(v) > 4]
    parts = [v[a:a + rnd.randrange(2, 6)] for v in rnd.sample(some, 12) for a in (rnd.randrange(3),)]
    cases = [(p, lit) for p in parts[:6] for lit in (True, False)] + [(f"^{p}", False) for p in parts[6:9]]
    cases += [("12.5", False), ("12.5", True), ("ABC", False), ("k123", True), ("123?4", False), ("12??34", False), ("123+", False), ("123|456", False), ("[1-3]456", False), ("12", False), ("çab", True), ("12+3", True), ("", False)]
    indexed = 0
    for search, literal in cases:
        for tier in (None, "High Risk") if search in ("ABC", "123+") else (None,):
            got = K.search_by_grams(cust, index, search, tier, literal)
            assert got.columns == cust.columns
            assert ns(got) == ns(search_customers(cust, search, tier, literal)), (search, literal)
        indexed += bool(search and K.needed_grams(search, literal))
    assert 10 <= indexed < len(cases)
    assert K.needed_grams("a??bcd") == ["bcd"] and K.needed_grams("1234*") == ["123"] and K.needed_grams("a(b)cde") == []


def scanned(df):
    """Rows that the plan's Parquet scan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookup_reads_few_row_groups(spark):
    rows = spark.range(0, 20000, 2).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("customer_id"), "id")
    index = K.key_index(rows)
    hit, miss = K.lookup_by_key(index, " 001234 "), K.lookup_by_key(index, "001235")
    assert [r["id"] for r in hit.collect()] == [1234] and miss.count() == 0
    assert 0 < scanned(hit) <= 10000 // 4
    assert scanned(K.lookup_by_key(index, "001235")) == 0  # inside a file's range: the bloom filter says no
    assert K.lookup_by_key(K.key_index(rows.limit(0)), "x").count() == 0


@pytest.mark.parametrize("buckets, level", [(1, 1024), (64, 1024), (64, 5), (600, 7)])
def test_running_sums_in_levels(spark, monkeypatch, buckets, level):
    monkeypatch.setattr(M, "LEVEL", level)
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).cast("double").alias("x"), (F.col("id") % 13).alias("a"), F.lit(1).alias("b"))
    got = M.prefix_sums(df, "x", ["a", "b"], buckets).orderBy("x").collect()
    total = 0
    for k, r in enumerate(got):
        total += r["a"]
        assert (r["cum_a"], r["cum_b"], r["tot_b"]) == (total, k + 1, 3000)
    assert got[-1]["tot_a"] == total and len(got) == 3000


def test_offsets_of_ten_thousand_buckets(spark):
    totals = spark.range(10000).select(F.col("id").cast("int").alias("_bucket"), (F.col("id") % 7).alias("_t_a"))
    total = 0
    for r in M.bucket_offsets(totals, ["a"]).orderBy("_bucket").collect():
        assert r["_o_a"] == total
        total += r["_bucket"] % 7
    assert r["tot_a"] == total
