import duckdb
import pytest

import corpus_pipeline
from churnscope.llm import host_rules
from tests.llm.conftest import DOCS


def test_a_rejected_host_loses_documents_that_pass(spark):
    rows = [("bad", True)] * 199 + [("bad", False)] * 10 + [("good", False)] * 200 + [("good", True)] * 3 + [("few", True)]
    measured = spark.createDataFrame(rows, "source string, base_failed boolean")
    kept = {(r["source"], r["base_failed"], r["kept"]): r["count"] for r in host_rules.judge(measured).groupBy("source", "base_failed", "kept").count().collect()}
    assert kept == {("bad", True, False): 199, ("bad", False, False): 10, ("good", False, True): 200, ("good", True, False): 3, ("few", True, False): 1}


def stored(spark, tmp_path, failing: str, passing: str):
    """Twenty ordinary hosts, and one of whose 100 documents 60 fail by one rule."""
    rows = [(f"host{h}", passing.format(n) if n else "too short") for h in range(20) for n in range(25)]
    rows += [("bad", failing.replace("{}", str(n)) if n < 60 else passing.format(n)) for n in range(100)]
    rows += [(None, passing.format(n)) for n in range(25)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return rows


CLEAN = " ".join(f"word{k}" for k in range(60)) + " number {}"
FAILING = {
    "short": "only number {}",
    "repeats": "again and again " * 40 + "{}",
    "symbols": CLEAN + " #$%&" * 30,
    "lines": "\n".join(f"unlike{k} {{}}\nsame" for k in range(40)),
}


@pytest.mark.parametrize("rule", FAILING)
def test_each_rule_rejects_a_host_of_which_60_percent_fail(spark, tmp_path, rule):
    rows = stored(spark, tmp_path, FAILING[rule], CLEAN)
    found = {r["doc_id"]: r for r in host_rules.op9_host_rules(spark, str(tmp_path)).collect()}
    for i, (host, text) in enumerate(rows):
        failed = text == "too short" or (rule in ("short", "repeats") and text != CLEAN.format(text.split()[-1]))
        assert found[i]["base_failed"] == failed, (rule, text)
        assert found[i]["kept"] == (not failed and host != "bad"), (rule, host)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = {r[0]: r[1:] for r in con.execute(host_rules.OP9_SQL).fetchall()}
    assert sql == {i: tuple(r)[1:] for i, r in found.items()}


def test_a_host_below_the_limit_loses_nothing(spark):
    rows = [(f"h{h}", n < 4) for h in range(20) for n in range(100)] + [("half", n < 40) for n in range(100)]
    measured = spark.createDataFrame(rows, "source string, base_failed boolean")
    assert host_rules.rejected_hosts(measured).count() == 0


def test_few_verdicts_deal_no_documents(spark):
    docs = spark.createDataFrame([(n, CLEAN.format(n) if n % 25 else "too short", "en", f"host{n % 20}", 1) for n in range(500)], DOCS)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "262144")
    try:
        good = corpus_pipeline.quality(spark, docs, "")
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert good.count() == 480
    finally:
        spark.conf.set(limit, before)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
