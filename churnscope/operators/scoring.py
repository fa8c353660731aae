"""C1-C3 applied, J3/W4 segment labels, the customer risk score table.

``fixture_probability`` is a deterministic churn probability (recency over
recency plus the churn window) used to check scoring, tiers, losses and
reports against SQL without a trained model; ``plans.model`` produces the
model probability used by the pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.functions.scalar import decision, risk_tier


def fixture_probability(cust: DataFrame, threshold: Column) -> DataFrame:
    r = F.col("recency").cast("double")
    return cust.withColumn("churn_prob", r / (r + threshold.cast("double")))


def fixture_segments(cust: DataFrame, k: int = C.N_SEGMENTS) -> DataFrame:
    """A deterministic stand-in for K-means ids: numeric id modulo k."""
    return cust.withColumn("segment_id", F.pmod(F.col("customer_id").cast("bigint"), F.lit(k)).cast("int"))


def label_segments(cust: DataFrame, labels=C.SEGMENT_LABELS) -> DataFrame:
    """Name segments by mean CLV rank (highest first; ties by id).

    The rank table has one row per segment id (k rows), so it is broadcast.
    """
    ranks = (cust.groupBy("segment_id").agg(F.avg("clv").alias("_m"))
             .withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_m"), F.asc("segment_id"))))
             .select("segment_id", F.element_at(F.array(*[F.lit(x) for x in labels]),
                                                F.col("_r").cast("int")).alias("segment")))
    return cust.join(F.broadcast(ranks), "segment_id", "left")


def financial_impact(df: DataFrame, cfg: RiskConfig = DEFAULT, p: str = "churn_prob") -> DataFrame:
    """Expected loss, retention gain, net and intervention ROI."""
    gain = F.col("clv") * F.lit(1 - cfg.discount)
    return df.withColumns({
        "expected_loss": F.col(p) * F.col("clv"),
        "retention_gain": gain,
        "net_roi": gain - F.lit(cfg.retention_cost),
    }).withColumn("intervention_roi", F.col("net_roi") * F.col(p))


def assign_decisions(df: DataFrame, cfg: RiskConfig = DEFAULT, p: str = "churn_prob") -> DataFrame:
    """C1 + C3: risk tier and retention decision."""
    return df.withColumns({
        "risk_tier": risk_tier(p, cfg),
        "decision": decision(p, "net_roi", cfg),
    })


SCORE_COLUMNS = (
    "customer_id", "recency", "frequency", "monetary", "avg_order_value",
    "product_diversity", "total_quantity", "geo_spread", "purchase_volatility",
    "avg_days_between_purchases", "spending_trend", "revenue_concentration",
    "spend_last30", "spend_30_90", "recency_acceleration", "weekend_ratio", "tenure",
    "churn", "clv", "segment_id", "segment", "churn_prob", "risk_tier",
    "expected_loss", "retention_gain", "net_roi", "intervention_roi", "decision",
)


def score_table(cust: DataFrame, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """The customer_risk_scores table from features with ``segment_id``,
    ``segment`` and ``churn_prob``."""
    out = assign_decisions(financial_impact(cust, cfg), cfg)
    return out.select(*SCORE_COLUMNS)
