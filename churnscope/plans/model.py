"""Churn model on Spark ML.

* M1 ``assemble``: VectorAssembler + StandardScaler (mean and sd of the
  training rows only, refitted inside every CV fold).
* M4-M6: two gradient-boosted tree models (different seeds, 80 % row and
  feature subsampling), a random forest and an L2 logistic regression whose
  penalty matches C = 0.5 (regParam = 1 / (C * n)).
* M7: soft voting, weighted mean of the class-1 probabilities.
* M8: isotonic calibration with k folds: the ensemble is fitted on k-1 folds,
  an isotonic map on the held-out fold; the score is the mean of the k
  calibrated scores. Prediction is score > 0.5.
* M9: k-fold cross-validation of the same procedure (3 models, 2 calibration
  folds), AUC per fold, mean and population sd.
* M12: scoring of all customers.

Folds and the train/test split are exact per class, by distributed ranks of a
per-customer hash (no global sort, stable under retries). Training rows are placed by customer hash, in
partitions by the number of rows, so row samples do not depend on session settings. Independent fits (folds, ensemble members, K-means
starts) are submitted from a thread pool so their Spark jobs run
concurrently, as ``CrossValidator(parallelism=...)`` does. Training data is
persisted (memory and disk); everything else stays lazy.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.operators.strata import with_parts
from churnscope.session import write_table

# Hash streams: 0 = train/test split, 2 = calibration folds, 3 = CV folds.
SPLIT_STREAM, CAL_STREAM, CV_STREAM = 0, 2, 3


def split_flag(cust: DataFrame, cfg: RiskConfig = DEFAULT, test_size: float = None,
               label: str = "churn") -> DataFrame:
    """M3: exact stratified split, ``is_test``: of every class the share
    ``test_size``, to within a row, in the order of a per-customer hash
    (``operators.strata``); membership does not depend on partitioning or retries."""
    t = cfg.test_size if test_size is None else test_size
    parts = with_parts(cust.drop("is_test"), [t, 1 - t], cfg.seed, SPLIT_STREAM, label, "_part")
    return parts.withColumn("is_test", F.col("_part") == 0).drop("_part")


def fold_column(df: DataFrame, k: int, stream: int, cfg: RiskConfig = DEFAULT, name: str = "fold",
                label: str = "churn") -> DataFrame:
    """M9: ``name`` = 0 .. k - 1, exact stratified folds: each holds a k-th of every class to within a row."""
    return with_parts(df, [1.0 / k] * k, cfg.seed, stream, label, name)


def _pool(n: int):
    return ThreadPoolExecutor(max_workers=max(1, min(n, 8)))


def fits_at_once(df: DataFrame, n_rows: int) -> int:
    """Fits on ``n_rows`` rows to run side by side: their tasks fill the cores. More would not end sooner, only keep
    others waiting; and as every fit holds its own copies of its rows, on large inputs they would fill the executors'
    memory and read their rows from disk, round after round."""
    return -(-df.sparkSession.sparkContext.defaultParallelism // training_partitions(n_rows))


def _fit_pool(df: DataFrame, n_rows: int, n: int):
    return ThreadPoolExecutor(max_workers=max(1, min(n, fits_at_once(df, n_rows))))


class Underway(dict):
    """Futures by name; reading one waits for its result."""

    def __getitem__(self, name):
        return super().__getitem__(name).result()

    def get(self, name, default=None):
        return self[name] if name in self else default


def at_once(*fits):
    """The results of independent fits, run side by side: each is a chain of small jobs that leaves cores idle."""
    with _pool(len(fits)) as ex:
        return [f.result() for f in [ex.submit(fit) for fit in fits]]


# ---------------------------------------------------------------- M1

def fit_scaler(df: DataFrame, cols=C.FEATURE_COLS) -> StandardScalerModel:
    raw = VectorAssembler(inputCols=list(cols), outputCol="raw", handleInvalid="keep").transform(df)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)


def assemble(df: DataFrame, scaler: StandardScalerModel, cols=C.FEATURE_COLS) -> DataFrame:
    """M1: ``features`` = standardised feature vector."""
    raw = VectorAssembler(inputCols=list(cols), outputCol="raw", handleInvalid="keep").transform(df)
    return scaler.transform(raw).drop("raw")


# ---------------------------------------------------------------- M4-M7

def member_specs(cfg: RiskConfig, with_logistic: bool = True):
    """(name, estimator factory, weight) of the soft-voting ensemble."""
    b, fo = cfg.boost, cfg.forest
    specs = [
        ("gbt_a", lambda n: GBTClassifier(maxIter=b.max_iter, maxDepth=b.max_depth, stepSize=b.step_size,
                                          subsamplingRate=b.subsampling_rate,
                                          featureSubsetStrategy=b.feature_subset, seed=cfg.seed),
         C.ENSEMBLE_WEIGHTS[0]),
        ("gbt_b", lambda n: GBTClassifier(maxIter=b.max_iter, maxDepth=b.max_depth, stepSize=b.step_size,
                                          subsamplingRate=b.subsampling_rate,
                                          featureSubsetStrategy=b.feature_subset, seed=cfg.seed + 1),
         C.ENSEMBLE_WEIGHTS[1]),
        ("forest", lambda n: RandomForestClassifier(numTrees=fo.num_trees, maxDepth=fo.max_depth,
                                                    minInstancesPerNode=fo.min_instances_per_node,
                                                    seed=cfg.seed),
         C.ENSEMBLE_WEIGHTS[2]),
    ]
    if with_logistic:
        specs.append(("logistic", lambda n: LogisticRegression(
            regParam=1.0 / (cfg.logistic_c * max(n, 1)), elasticNetParam=0.0, standardization=False,
            maxIter=cfg.logistic_max_iter), C.ENSEMBLE_WEIGHTS[3]))
    return specs


def _rename_outputs(model, tag: str):
    model.setProbabilityCol(f"prob_{tag}").setRawPredictionCol(f"rawp_{tag}").setPredictionCol(f"pred_{tag}")
    return model


def soft_vote(df: DataFrame, members, out: str) -> DataFrame:
    """M7: weighted mean of the class-1 probability of each member."""
    num = None
    for tag, model, w in members:
        df = model.transform(df)
        term = vector_to_array(F.col(f"prob_{tag}"))[1] * F.lit(float(w))
        num = term if num is None else num + term
        df = df.drop(f"rawp_{tag}", f"pred_{tag}")
    total = float(sum(w for _, _, w in members))
    df = df.withColumn(out, num / F.lit(total))
    return df.drop(*[f"prob_{tag}" for tag, _, _ in members])


# ---------------------------------------------------------------- M8 model

@dataclass
class ChurnModel:
    """Scaler + k calibrated soft-voting ensembles."""
    feature_cols: tuple
    scaler: StandardScalerModel
    folds: list = field(default_factory=list)      # [[(tag, model, weight), ...], ...]
    calibrators: list = field(default_factory=list)  # [IsotonicRegressionModel, ...]

    def transform(self, df: DataFrame, out: str = "churn_prob") -> DataFrame:
        """Add the calibrated churn probability (and keep all columns)."""
        d = assemble(df, self.scaler, self.feature_cols)
        cal = []
        for i, (members, iso) in enumerate(zip(self.folds, self.calibrators)):
            d = soft_vote(d, members, f"_vote{i}")
            iso.setFeaturesCol(f"_vote{i}").setPredictionCol(f"_cal{i}")
            d = iso.transform(d)
            cal.append(F.col(f"_cal{i}"))
        p = sum(cal[1:], cal[0]) / F.lit(float(len(cal)))
        d = d.withColumn(out, p)
        return d.drop("features", *[f"_vote{i}" for i in range(len(cal))],
                      *[f"_cal{i}" for i in range(len(cal))])

    # S4 ----------------------------------------------------------------
    def write(self):
        return _ModelWriter(self)


class _ModelWriter:
    def __init__(self, m: ChurnModel):
        self.m = m
        self._overwrite = False

    def overwrite(self):
        self._overwrite = True
        return self

    def save(self, path: str):
        m = self.m
        m.scaler.write().overwrite().save(f"{path}/scaler")
        manifest = {"feature_cols": list(m.feature_cols), "folds": []}
        for i, (members, iso) in enumerate(zip(m.folds, m.calibrators)):
            iso.write().overwrite().save(f"{path}/fold{i}/isotonic")
            entry = []
            for tag, model, w in members:
                model.write().overwrite().save(f"{path}/fold{i}/{tag}")
                entry.append({"tag": tag, "kind": type(model).__name__, "weight": w})
            manifest["folds"].append(entry)
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/manifest")


_KINDS = {
    "GBTClassificationModel": GBTClassificationModel,
    "RandomForestClassificationModel": RandomForestClassificationModel,
    "LogisticRegressionModel": LogisticRegressionModel,
}


def load_any(path: str) -> ChurnModel:
    """Load a ``ChurnModel`` saved with ``write().save(path)``."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    scaler = StandardScalerModel.load(f"{path}/scaler")
    folds, cals = [], []
    for i, entry in enumerate(manifest["folds"]):
        members = [(e["tag"], _KINDS[e["kind"]].load(f"{path}/fold{i}/{e['tag']}"), e["weight"]) for e in entry]
        for tag, model, _ in members:
            _rename_outputs(model, tag)
        folds.append(members)
        cals.append(IsotonicRegressionModel.load(f"{path}/fold{i}/isotonic"))
    return ChurnModel(tuple(manifest["feature_cols"]), scaler, folds, cals)


def fit_isotonic(scored: DataFrame, score: str, label: str,
                 prediction: str = "_cal") -> IsotonicRegressionModel:
    """Increasing isotonic map from ``score`` to the rate of ``label``.

    The fit reads one row per distinct score (mean label, weight = rows).
    Spark ML pools equal scores into this weighted mean anyway, but it would
    first range-partition and sort the raw rows in memory, so a score shared
    by a large share of customers would sit in one task. Grouping first is
    partially aggregated before its shuffle.
    """
    pooled = scored.groupBy(score).agg(
        F.avg(F.col(label).cast("double")).alias(label),
        F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol=score, labelCol=label, weightCol="_w",
                              predictionCol=prediction, isotonic=True).fit(pooled)


#: Rows of a partition, of fits that run side by side and of one that has the cluster to itself.
ROWS_PER_TRAINING_PARTITION, ROWS_ALONE = 500_000, 100_000


def training_partitions(n_rows: int, alone: bool = False) -> int:
    """Partitions for an iterative fit, by its rows, whatever the session.
    Every optimiser iteration is a job over all partitions, and every task
    reports to the driver, so tiny inputs train fastest in one partition and
    large ones spread out: a fit alone over one per 100k rows, fits side by
    side, which fill the cores together, over one per 500k."""
    return max(1, -(-n_rows // (ROWS_ALONE if alone else ROWS_PER_TRAINING_PARTITION)))


def placed(df: DataFrame, partitions: int = None, alone: bool = False) -> DataFrame:
    """Rows dealt by hash of the customer and ordered within each partition, persisted.

    Spark ML draws row samples and K-means starts by partition and position, so
    these follow from the customers and the seed only."""
    if partitions is None:
        partitions = training_partitions(df.count(), alone)
    return df.repartition(partitions, "customer_id").sortWithinPartitions("customer_id").persist(StorageLevel.MEMORY_AND_DISK)


def _training_frame(df: DataFrame, label: str, partitions: int = None, alone: bool = False) -> DataFrame:
    return placed(df.withColumn("label", F.col(label).cast("double")), partitions, alone)


def fit_calibrated(train: DataFrame, cfg: RiskConfig = DEFAULT, folds: int = None,
                   with_logistic: bool = True, label: str = "churn",
                   cols=C.FEATURE_COLS, partitions: int = None, pool: ThreadPoolExecutor = None,
                   begun=None) -> ChurnModel:
    """M8: scaler on ``train``, then per calibration fold an ensemble on the
    other folds and an isotonic map (clipped) on the held-out fold. Several calls
    may share the ``pool`` that their fits run in; ``begun`` is called before the
    first of them."""
    k = cfg.calibration_folds if folds is None else folds
    # Written first: every task of the fits reports the metrics of all the operators since the last exchange, and
    # iterative fits run many small tasks, so the joins of the folds would be most of what reaches the driver.
    named = [c for c in dict.fromkeys(["customer_id", label, *cols]) if c in train.columns]
    folded = write_table(fold_column(train, k, CAL_STREAM, cfg, "_cf", label).select(*named, "_cf"), "training")
    rows = _training_frame(folded, label, partitions)
    scaler = fit_scaler(rows, cols)
    data = assemble(rows, scaler, cols)
    specs = member_specs(cfg, with_logistic)
    counts = {r["_cf"]: r["count"] for r in data.groupBy("_cf").count().collect()}
    n_total = sum(counts.values())

    def fit_member(args):
        f, (name, make, w) = args
        fit_df = data.filter(F.col("_cf") != f)
        model = make(n_total - counts.get(f, 0)).fit(fit_df)
        return f, name, _rename_outputs(model, f"{name}{f}"), w

    if begun is not None:
        begun()
    with nullcontext(pool) if pool is not None else _fit_pool(data, n_total, k * len(specs)) as ex:
        fitted = list(ex.map(fit_member, [(f, s) for f in range(k) for s in specs]))
    fold_members = [[(f"{name}{f}", m, w) for ff, name, m, w in fitted if ff == f] for f in range(k)]

    def fit_iso(f):
        held = soft_vote(data.filter(F.col("_cf") == f), fold_members[f], "_vote")
        return fit_isotonic(held, "_vote", "label", "_cal")

    with _fit_pool(data, n_total, k) as ex:
        isos = list(ex.map(fit_iso, range(k)))
    rows.unpersist()
    return ChurnModel(tuple(cols), scaler, fold_members, isos)


def score_customers(cust: DataFrame, model: ChurnModel) -> DataFrame:
    """Calibrated churn probability for every customer."""
    return model.transform(cust)


def cross_validate(cust: DataFrame, cfg: RiskConfig = DEFAULT, folds: int = None,
                   label: str = "churn") -> DataFrame:
    """M9: (fold, auc) of the 3-model calibrated ensemble (2 calibration
    folds) refitted on every training fold, scaler included."""
    from churnscope.operators.metrics import ranking_metrics
    k = cfg.cv_folds if folds is None else folds
    d = write_table(fold_column(cust, k, CV_STREAM, cfg, "_cv", label), "cv-folds")  # read twice a fold

    n_rows = d.count()

    def run(f):
        m = fit_calibrated(d.filter(F.col("_cv") != f), cfg, folds=2, with_logistic=False, label=label, pool=fits)
        held = m.transform(d.filter(F.col("_cv") == f))
        auc = ranking_metrics(held, label, "churn_prob").select("auc").first()["auc"]
        return f, float(auc) if auc is not None else None

    n_fits = k * 2 * len(member_specs(cfg, with_logistic=False))
    with _fit_pool(d, n_rows, n_fits) as fits, _fit_pool(d, n_rows, k) as ex:
        rows = list(ex.map(run, range(k)))
    return cust.sparkSession.createDataFrame(rows, "fold int, auc double")


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population sd of the fold AUCs (4 places, half-even)."""
    return cv.agg(F.bround(F.avg("auc"), 4).alias("cv_auc_mean"),
                  F.bround(F.stddev_pop("auc"), 4).alias("cv_auc_std"))


def model_metrics(scored_test: DataFrame, cv: DataFrame = None, label: str = "churn") -> DataFrame:
    """The model_metrics table: hold-out metrics (4 places) and CV summary."""
    from churnscope.operators.metrics import binary_metrics
    m = binary_metrics(scored_test, label, "churn_prob")
    m = m.select(*[F.bround(F.col(c), 4).alias(c) for c in m.columns])
    if cv is None:
        return m.withColumns({"cv_auc_mean": F.lit(None).cast("double"),
                              "cv_auc_std": F.lit(None).cast("double")})
    s = cv_summary(cv).select(F.struct("cv_auc_mean", "cv_auc_std")).scalar()
    return m.select("*", s.getField("cv_auc_mean").alias("cv_auc_mean"),
                    s.getField("cv_auc_std").alias("cv_auc_std"))


def load_model(path: str) -> ChurnModel:
    return load_any(path)


def model_dir(spark, name: str) -> str:
    from churnscope.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "models", name)
