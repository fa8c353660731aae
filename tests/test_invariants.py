"""Invariants of the operators without a SQL equivalent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope import queries as Q
from churnscope.operators import features as FE
from churnscope.operators import metrics as ME
from churnscope.operators import portfolio as PF
from churnscope.operators.quantiles import exact_quantiles
from tests.conftest import SF001


def test_tier_counts_sum_to_customers(spark):
    s = Q.scored_of(spark, SF001)
    from churnscope.operators.summaries import tier_distribution
    td = tier_distribution(s).collect()
    assert [r["risk_tier"] for r in sorted(td, key=lambda r: r["tier_order"])] == list(C.TIER_ORDER)
    assert sum(r["customers"] for r in td) == s.count()


def test_monte_carlo_moments_and_tail(spark):
    s = Q.scored_of(spark, SF001)
    losses = PF.loss_distribution(s, n_sims=2000, seed=7)
    st = PF.loss_stats(losses).first()
    mom = s.agg(F.sum(F.col("churn_prob") * F.col("clv")).alias("m"),
                F.sum(F.col("churn_prob") * (1 - F.col("churn_prob")) * F.col("clv") ** 2).alias("v")).first()
    se = (mom["v"] / 2000) ** 0.5
    assert abs(st["mc_mean_loss"] - mom["m"]) < 4 * se
    assert st["var_95"] <= st["cvar_95"]
    assert st["mc_simulations"] == 2000


def test_baseline_scenario_equals_expected_loss(spark):
    s = Q.scored_of(spark, SF001)
    ref = s.agg(F.sum(F.col("churn_prob") * F.col("clv"))).first()[0]
    st = {r["scenario"]: r for r in PF.stress_test(s, F.lit(ref)).collect()}
    assert st["Baseline"]["expected_loss"] == pytest.approx(round(ref), abs=1)
    assert st["Baseline"]["loss_delta_pct"] == 0.0
    assert st["Severe Crisis"]["high_risk_customers"] >= st["Baseline"]["high_risk_customers"]


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.full(3000, 5.0), rng.normal(size=6000), rng.integers(0, 9, 1000).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    qs = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, [("x", q) for q in qs], accuracy=200)
    for q in qs:
        assert got[("x", q)] == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)


def _np_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _np_ap(y, p):
    order = np.argsort(-p, kind="mergesort")
    ap, tp, n = 0.0, 0, 0
    P = y.sum()
    for s in np.unique(p)[::-1]:
        m = p == s
        tp += y[m].sum()
        n += m.sum()
        ap += (y[m].sum() / P) * (tp / n)
    return ap


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_ranking_metrics_match_numpy(spark, buckets):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(3000), 2)
    y = (rng.random(3000) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(5)
    r = ME.binary_metrics(df, "y", "p", n_buckets=buckets).first()
    assert r["auc"] == pytest.approx(_np_auc(y, p), abs=1e-12)
    assert r["avg_precision"] == pytest.approx(_np_ap(y, p), abs=1e-12)
    pred = p > 0.5
    tp = (pred & (y == 1)).sum()
    assert r["precision"] == pytest.approx(tp / pred.sum())
    assert r["recall"] == pytest.approx(tp / (y == 1).sum())
    assert r["brier_score"] == pytest.approx(np.mean((p - y) ** 2))


def test_features_independent_of_partitioning(spark):
    tx = Q.tx_of(spark, SF001)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(FE.customer_features(tx).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    b = sorted(FE.customer_features(tx.repartition(13)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for k in ra.asDict():
            if isinstance(ra[k], str):
                assert ra[k] == rb[k]
            else:
                assert ra[k] == pytest.approx(rb[k], rel=1e-12, abs=1e-9)


def test_kmeans_labels_follow_clv_rank(spark):
    from churnscope.config import FAST
    from churnscope.plans.segments import segment
    seg = segment(Q.cust_of(spark, SF001), FAST)
    rows = seg.groupBy("segment").agg(F.avg("clv").alias("m")).collect()
    order = [r["segment"] for r in sorted(rows, key=lambda r: -r["m"])]
    assert order == [s for s in C.SEGMENT_LABELS if s in order]


def test_model_save_load_and_calibration(spark, tmp_path):
    from churnscope.config import FAST
    from churnscope.plans.model import fit_calibrated, load_any
    cust = Q.cust_of(spark, SF001)
    m = fit_calibrated(cust, FAST)
    a = {r["customer_id"]: r["churn_prob"] for r in m.transform(cust).collect()}
    m.write().overwrite().save(str(tmp_path / "m"))
    b = {r["customer_id"]: r["churn_prob"] for r in load_any(str(tmp_path / "m")).transform(cust).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert all(0.0 <= v <= 1.0 for v in a.values())
    # each isotonic map is monotone: sorting by vote never lowers the calibrated score
    for iso in m.calibrators:
        bnd = iso.boundaries.toArray()
        pr = iso.predictions.toArray()
        assert np.all(np.diff(bnd) >= 0) and np.all(np.diff(pr) >= -1e-12)


def test_contributions_add_up_to_margin(spark):
    from churnscope.config import FAST
    from churnscope.plans import explain as X
    cust = Q.cust_of(spark, SF001)
    scaler, gbt = X.fit_explainer(cust, FAST)
    bg = X.background(cust, scaler, FAST, n=20)
    contrib = X.contributions(cust, scaler, gbt, bg)
    phi = {r["customer_id"]: r["s"] for r in contrib.groupBy("customer_id").agg(F.sum("phi").alias("s")).collect()}
    base = X.base_value(gbt, spark, bg)
    marg = {r["customer_id"]: r["margin"] for r in X.margins(cust, scaler, gbt).collect()}
    assert phi.keys() == marg.keys()
    for k in marg:
        assert phi[k] + base == pytest.approx(marg[k], abs=1e-9)
    top = X.top_contributions(contrib, 8)
    assert top.groupBy("customer_id").count().agg(F.max("count")).first()[0] == 8


def test_pooled_isotonic_equals_raw_fit(spark):
    """The isotonic fit on one row per distinct score equals Spark ML's fit on
    the raw rows, with a score value shared by a third of the rows."""
    from pyspark.ml.regression import IsotonicRegression

    from churnscope.plans.model import fit_isotonic
    rows = [(0.5, i % 3 == 0) for i in range(3000)]  # hot tie: 3000 rows at 0.5
    rows += [((i % 97) / 97.0, (i * 7) % 5 < 2) for i in range(6000)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "s double, y int").repartition(4)
    raw = IsotonicRegression(featuresCol="s", labelCol="y", isotonic=True).fit(
        df.withColumn("y", F.col("y").cast("double")))
    pooled = fit_isotonic(df, "s", "y")
    assert list(raw.boundaries.toArray()) == list(pooled.boundaries.toArray())
    for a, b in zip(raw.predictions.toArray(), pooled.predictions.toArray()):
        assert abs(a - b) < 1e-12


def test_ranking_metrics_unique_scores_many_buckets(spark):
    """Near-unique scores cut into many range buckets give the exact AUC/AP."""
    rng = np.random.default_rng(5)
    p = rng.random(4000)
    y = (rng.random(4000) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(6)
    r = ME.binary_metrics(df, "y", "p", n_buckets=512).first()
    assert r["auc"] == pytest.approx(_np_auc(y, p), abs=1e-12)
    assert r["avg_precision"] == pytest.approx(_np_ap(y, p), abs=1e-12)
