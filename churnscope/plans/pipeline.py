"""The end-to-end batch pipeline, and the older baseline pipeline.

Intermediate tables are written once to the shared checkpoint folder (clean
lines, customer features, scores), which cuts lineage and lets a lost
executor's work be recomputed from durable data. Results go to ``out_dir``
(S3) and the model is saved with Spark ML writers (S4).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.operators import cohorts as CO
from churnscope.operators import features as FE
from churnscope.operators import metrics as ME
from churnscope.operators import portfolio as PF
from churnscope.operators import scoring as SC
from churnscope.operators.clean import clean
from churnscope.session import write_table
from churnscope.sources.results import write_results


def run_pipeline(spark: SparkSession, raw: DataFrame, cfg: RiskConfig = DEFAULT, out_dir: str = None,
                 cross_validation: bool = True, explain: bool = True, fmt: str = "parquet",
                 fits: dict = None) -> dict:
    """Clean -> features -> label -> segments -> cohorts -> model -> scores ->
    losses -> stress -> contributions; returns the result DataFrames. ``fits``
    may hold the ``model``, ``cv`` table and ``explainer`` of the same customers
    and config; what it lacks is fitted here. Each is asked for where it is first
    needed, so fits may still be under way (``model.Underway``)."""
    fits = fits or {}
    from churnscope.plans import explain as X
    from churnscope.plans.model import cross_validate, fit_calibrated, model_dir, model_metrics, split_flag
    from churnscope.plans.segments import segment

    tx = write_table(clean(raw), "tx")
    cust = write_table(FE.labelled_features(tx, cfg), "customer_features")
    seg = segment(cust, cfg)
    retention = CO.cohort_retention(tx, cust)

    data = write_table(split_flag(seg, cfg), "split_customers")
    train = data.filter(~F.col("is_test"))
    model = fits.get("model") or fit_calibrated(train, cfg)
    test_scored = model.transform(data.filter(F.col("is_test")))
    report = ME.class_report(test_scored, "churn", "churn_prob")

    scores = write_table(SC.score_table(model.transform(seg), cfg), "customer_risk_scores")
    losses = write_table(PF.loss_distribution(scores, cfg=cfg), "losses")
    stats = PF.loss_stats(losses, cfg=cfg)
    stress = PF.stress_test(scores, losses.agg(F.avg("loss")).scalar(), cfg)
    cv = (fits["cv"] if "cv" in fits else cross_validate(cust, cfg)) if cross_validation else None
    metrics = model_metrics(test_scored, cv)

    results = {
        "customer_risk_scores": scores,
        "model_metrics": metrics,
        "class_report": report,
        "loss_stats": stats,
        "losses": losses,
        "stress_tests": stress,
        "cohort_retention": retention,
        "feature_cols": spark.createDataFrame([(c,) for c in C.FEATURE_COLS], "feature string"),
    }
    if explain:
        scaler, gbt = fits.get("explainer") or X.fit_explainer(train, cfg)
        bg = X.background(train, scaler, cfg)
        results["contributions"] = X.contributions(data.filter(F.col("is_test")), scaler, gbt, bg)
    if out_dir:
        write_results(results, out_dir, fmt, extra=lambda folder: model.write().overwrite().save(f"{folder}/model"))
    else:
        model.write().overwrite().save(model_dir(spark, f"churn_model-{uuid.uuid4().hex}"))
    results["model"] = model
    return results


def run_baseline(spark: SparkSession, raw: DataFrame, cfg: RiskConfig = DEFAULT, out_dir: str = None) -> dict:
    """The older pipeline: RFM + trend features, one boosted-tree model on all
    features but churn and recency, four-way decisions."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from churnscope.functions.scalar import baseline_decision
    from churnscope.plans.model import placed, split_flag

    tx = write_table(clean(raw), "tx_baseline")
    feats = write_table(FE.baseline_features(tx, cfg), "baseline_features")
    cols = ["frequency", "monetary", "avg_order_value", "trend"]
    # A customer without invoices has an infinite order value in this table;
    # the model input maps it to 0.
    model_in = feats.withColumn("avg_order_value", F.when(F.abs("avg_order_value") == float("inf"), 0.0)
                                .otherwise(F.col("avg_order_value")))
    va = VectorAssembler(inputCols=cols, outputCol="features")
    d = va.transform(write_table(split_flag(model_in, cfg), "baseline_split").withColumn("label", F.col("churn").cast("double")))
    bb = cfg.baseline_boost
    train = placed(d.filter(~F.col("is_test")), alone=True)
    gbt = GBTClassifier(maxIter=bb.max_iter, maxDepth=bb.max_depth, stepSize=bb.step_size,
                        subsamplingRate=bb.subsampling_rate, featureSubsetStrategy=bb.feature_subset,
                        seed=cfg.seed).fit(train)
    train.unpersist()
    scored = gbt.transform(d).withColumn("churn_prob", vector_to_array("probability")[1])
    clv = F.col("monetary") * F.lit(cfg.margin)
    gain = clv * F.lit(1 - cfg.discount)
    out = scored.select(
        "customer_id", "recency", "frequency", "monetary", "avg_order_value", "trend", "churn", "is_test",
        "churn_prob", clv.alias("clv"), (F.col("churn_prob") * clv).alias("expected_loss"),
        gain.alias("retention_gain"), (gain - F.lit(cfg.retention_cost)).alias("roi"),
    ).withColumn("decision", baseline_decision("churn_prob", "roi"))
    test = out.filter(F.col("is_test"))
    results = {
        "customer_features": feats,
        "baseline_decisions": out,
        "baseline_metrics": ME.binary_metrics(test, "churn", "churn_prob"),
        "baseline_class_report": ME.class_report(test, "churn", "churn_prob"),
    }
    if out_dir:
        write_results(results, out_dir)
    return results
