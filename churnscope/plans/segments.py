"""M2 (+ W4, A3): K-means customer segments labelled by CLV rank.

Segmentation standardises recency, frequency, monetary, order value and
tenure, runs Spark ML K-means (k-means|| initialisation) from several seeds
concurrently and keeps the run with the lowest within-cluster cost. Segment
ids are then named by mean CLV rank (``operators.scoring.label_segments``).
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.operators.scoring import label_segments
from churnscope.plans.model import _pool, placed


def fit_segments(cust: DataFrame, cfg: RiskConfig = DEFAULT, k: int = None, starts: int = None,
                 cols=C.SEGMENT_FEATURES):
    """Fit scaler + best-of-``starts`` K-means; returns (scaler, kmeans model)."""
    k = cfg.n_segments if k is None else k
    starts = cfg.kmeans_starts if starts is None else starts
    rows = placed(cust.select("customer_id", *cols))
    raw = VectorAssembler(inputCols=list(cols), outputCol="seg_raw").transform(rows)
    scaler = StandardScaler(inputCol="seg_raw", outputCol="seg_features", withMean=True, withStd=True).fit(raw)
    data = scaler.transform(raw).select("seg_features")

    def run(i):
        return KMeans(k=k, seed=cfg.seed + i, featuresCol="seg_features", predictionCol="segment_id",
                      maxIter=300, tol=1e-4).fit(data)

    with _pool(starts) as ex:
        models = list(ex.map(run, range(starts)))
    rows.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return scaler, best


def segment(cust: DataFrame, cfg: RiskConfig = DEFAULT, k: int = None, starts: int = None,
            cols=C.SEGMENT_FEATURES) -> DataFrame:
    """M2 + W4: ``segment_id`` and ``segment`` label on every customer."""
    scaler, km = fit_segments(cust, cfg, k, starts, cols)
    raw = VectorAssembler(inputCols=list(cols), outputCol="seg_raw").transform(cust)
    out = km.transform(scaler.transform(raw)).drop("seg_raw", "seg_features")
    out = out.withColumn("segment_id", F.col("segment_id").cast("int"))
    return label_segments(out)
