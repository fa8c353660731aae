"""What-if scoring of request rows.

A request gives recency, frequency, monetary, tenure, product diversity and
order value. The other model features are the customer medians (computed
exactly and distributed, see ``operators.quantiles``), CLV and the spend
windows are derived from the requested monetary value, then the model, the
tier, ROI and decision are applied. Requests are a DataFrame, so any number
of them are scored in one job; the medians are a handful of literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.functions.scalar import decision, risk_tier
from churnscope.operators.quantiles import exact_quantiles

REQUEST_FIELDS = ("recency", "frequency", "monetary", "tenure", "product_diversity", "avg_order_value")


def whatif_features(requests: DataFrame, cust: DataFrame, cfg: RiskConfig = DEFAULT,
                    cols=C.FEATURE_COLS) -> DataFrame:
    """The feature row of every request (request_id, recency and the model features)."""
    med = exact_quantiles(cust, [(c, 0.5) for c in cols])
    m = F.col("monetary").cast("double")
    s30 = m * F.lit(C.WHATIF_SPEND_LAST30_SHARE)
    s3090 = m * F.lit(C.WHATIF_SPEND_30_90_SHARE)
    derived = {
        "clv": m * F.lit(cfg.margin),
        "spend_last30": s30,
        "spend_30_90": s3090,
        "recency_acceleration": (s30 + 1) / (s3090 + 1),
    }
    out = [F.col("request_id"), F.col("recency").cast("double").alias("recency")]
    for c in cols:
        if c in REQUEST_FIELDS:
            out.append(F.col(c).cast("double").alias(c))
        elif c in derived:
            out.append(derived[c].alias(c))
        else:
            v = med[(c, 0.5)]
            out.append(F.lit(0.0 if v is None else float(v)).alias(c))
    return requests.select(*out)


def whatif_scores(requests: DataFrame, cust: DataFrame, model, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """Probability (% to 1 place), tier, expected loss, net ROI, decision, CLV."""
    fv = whatif_features(requests, cust, cfg).withColumn("customer_id", F.col("request_id"))
    p = model.transform(fv)
    clv = F.col("clv")
    roi = clv * F.lit(1 - cfg.discount) - F.lit(cfg.retention_cost)
    return p.select(
        "request_id",
        F.bround(F.col("churn_prob") * 100, 1).alias("churn_probability"),
        risk_tier("churn_prob", cfg).alias("risk_tier"),
        F.bround(F.col("churn_prob") * clv, 2).alias("expected_loss"),
        F.bround(roi, 2).alias("net_roi"),
        decision(F.col("churn_prob"), roi, cfg).alias("decision"),
        F.bround(clv, 2).alias("clv"),
    )


def requests_from_customers(cust: DataFrame) -> DataFrame:
    """What-if requests built from each customer's own six API fields."""
    return cust.select(F.col("customer_id").alias("request_id"), *REQUEST_FIELDS)
