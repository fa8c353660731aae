"""Loss curve, stratified parts, paging and published results against plain definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.operators import loss_curve as L
from churnscope.operators.paging import order_index, page_of
from churnscope.operators.strata import with_parts
from churnscope.operators.summaries import PAGE_COLUMNS
from churnscope.sources import results as R


# ---------------------------------------------------------------- loss curve

def convolved(ps, cs):
    """Atoms of the loss by brute force: {loss: probability}."""
    dist = {0: 1.0}
    for p, c in zip(ps, cs):
        new = {}
        for x, q in dist.items():
            new[x] = new.get(x, 0) + q * (1 - p)
            new[x + c] = new.get(x + c, 0) + q * p
        dist = new
    return sorted(dist.items())


def plain_stats(atoms, conf):
    x, q = np.array([a for a, _ in atoms], float), np.array([b for _, b in atoms])
    cum = np.cumsum(q)
    k = int(np.searchsorted(cum, conf - 1e-12))
    cvar = ((x * q)[k + 1 :].sum() + (cum[k] - conf) * x[k]) / (1 - conf)
    return (x * q).sum(), x, cum, x[k], cvar


CASES = {
    "two": ([0.3, 0.9], [100, 40]), "one giant": ([0.001] + [0.3] * 40, [100_000] + [3] * 40), "equal": ([0.5] * 30, [10] * 30),
    "certain and none": ([1.0, 0.0, 0.2, 0.7], [50, 70, 30, 20]), "many": ([random.Random(1).random() for _ in range(200)], [random.Random(k).randrange(1, 60) for k in range(200)]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("conf", [0.5, 0.95, 0.99])
def test_curve_against_convolution(spark, name, conf):
    ps, cs = CASES[name]
    curve = L.loss_curve(spark.createDataFrame([(p, float(c)) for p, c in zip(ps, cs)] + [(None, 5.0), (0.4, None)], "churn_prob double, clv double"))
    mean, x, cum, var, cvar = plain_stats(convolved(ps, cs), conf)
    s = L.curve_stats(curve, conf).first()
    assert s["mean_loss"] == pytest.approx(mean, abs=1e-6 * sum(cs))
    err = s["grid_error"] + 1e-9
    low, high = np.searchsorted(cum, conf - 1e-8), min(np.searchsorted(cum, conf + 1e-8), len(x) - 1)
    assert x[low] - err <= s["var_95"] <= x[high] + err
    assert abs(s["cvar_95"] - cvar) <= err + 1e-6 * sum(cs)
    assert err <= 0.004 * sum(cs) + 1e-9
    m = L.curve_moments(curve).first()
    assert m["sd_loss"] == pytest.approx(math.sqrt(sum(p * (1 - p) * c * c for p, c in zip(ps, cs))), rel=1e-6, abs=1e-6)


def test_nothing_open(spark):
    for rows, mean in (([], 0.0), ([(1.0, 7.0), (0.0, 9.0)], 7.0)):
        s = L.curve_stats(L.loss_curve(spark.createDataFrame(rows, "churn_prob double, clv double"))).first()
        assert (s["mean_loss"], s["var_95"], s["cvar_95"], s["grid_error"]) == (mean, mean, mean, 0.0)


# ---------------------------------------------------------------- stratified parts

@pytest.mark.parametrize("bits", [0, 2, 12])
def test_parts_hold_their_share_of_each_class(spark, bits):
    """Whatever the buckets: a part of a class is within a row of its share, and equal for any number of buckets and partitions."""
    df = spark.range(1003).select(F.concat(F.lit("c"), "id").alias("customer_id"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 97 == 1, None).otherwise(0).alias("churn"))
    shares = [0.2, 0.5, 0.3]
    got = with_parts(df.repartition(5), shares, 42, 0, bucket_bits=bits).collect()
    assert len(got) == 1003
    for label in (0, 1, None):
        held = [r["part"] for r in got if r["churn"] == label]
        done = 0.0
        for k, s in enumerate(shares):
            assert abs(held.count(k) - s * len(held)) <= 1
            done += s
    assert {(r["customer_id"], r["part"]) for r in got} == {(r["customer_id"], r["part"]) for r in with_parts(df, shares, 42, 0).collect()}


def test_many_rows_of_one_id(spark):
    df = spark.range(300).select(F.lit("same").alias("customer_id"), F.lit(1).alias("churn"))
    got = with_parts(df, [0.25, 0.75], 1, 0)
    assert got.filter("part = 0").count() == 75


# ---------------------------------------------------------------- pages

def test_any_page_without_an_offset(spark):
    """A third of the customers share a probability; each page equals the slice of the sorted list."""
    r = random.Random(2)
    rows = [(f"{k:05d}", 0.5 if k % 3 == 0 else r.random(), r.choice(["High Risk", "Low Risk"])) for k in range(2000)]
    index = order_index(spark.createDataFrame(rows, "customer_id string, churn_prob double, risk_tier string"), 16)
    assert index.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 400
    ordered = sorted(rows, key=lambda x: (-x[1], x[0]))
    for page, limit, search, tier in ((1, 20, None, None), (57, 20, None, None), (100, 20, None, None), (101, 20, None, None), (3, 7, "7$", "Low Risk"), (1, 5000, None, None), (2, 300, "1", None), (1, 5, "none", None)):
        want = [x for x in ordered if (not search or (x[0].endswith("7") if search == "7$" else search in x[0])) and (not tier or x[2] == tier)]
        df = page_of(index, page, limit, search, tier)
        got = sorted(((x["customer_id"], x["churn_prob"], x["risk_tier"]) for x in df.collect()), key=lambda x: (-x[1], x[0]))
        assert got == want[(page - 1) * limit : page * limit]
        assert all(x["total"] == len(want) for x in df.collect()) and set(df.columns) <= {*PAGE_COLUMNS, "total"}
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "Offset" not in plan and "rangepartitioning" not in plan


# ---------------------------------------------------------------- results published together

def test_a_failed_write_leaves_the_earlier_set(spark, tmp_path):
    folder = str(tmp_path / "r")
    one = {"a": spark.range(3).toDF("x"), "b": spark.range(2).selectExpr("id + 10 AS y")}
    R.write_results(one, folder)
    held = R.read_results(spark, folder)
    broken = {"a": spark.range(30).toDF("x"), "b": spark.range(2).selectExpr("CASE WHEN id = 1 THEN raise_error('lost') ELSE id END AS y")}
    with pytest.raises(Exception, match="lost"):
        R.write_results(broken, folder)
    now = R.read_results(spark, folder)
    assert now["a"].count() == 3 and now["b"].count() == 2 and held["a"].count() == 3
    R.write_results({"a": spark.range(4).toDF("x")}, folder)
    assert set(R.read_results(spark, folder)) == {"a"} and R.read_results(spark, folder)["a"].count() == 4
    assert held["b"].count() == 2  # the run before is still there for its readers
    R.write_results({"a": spark.range(5).toDF("x")}, folder)
    runs = R._runs(spark, folder)
    assert len(runs) == 3 and R.read_results(spark, folder)["a"].count() == 5  # two published ones and the one that failed
    with pytest.raises(FileNotFoundError):
        R.read_results(spark, str(tmp_path / "none"))


def test_the_model_is_part_of_its_run(spark, tmp_path):
    folder = str(tmp_path / "m")
    R.write_results({"a": spark.range(1).toDF("x")}, folder, extra=lambda f: spark.range(7).write.parquet(f"{f}/model"))
    assert spark.read.parquet(R.results_folder(spark, folder) + "/model").count() == 7


# ---------------------------------------------------------------- entry

def test_entry_without_an_optional_library(monkeypatch):
    import sys

    import __spark_entry__ as E
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("churnscope.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert "pipeline" not in E.queries() and "F21_customer_features" in E.queries() and len(E.oracle_sql()) >= 79
