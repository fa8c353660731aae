"""Tasks of iterative fits: what they report to the driver, and fits that run side by side."""

import threading

from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import FAST
from churnscope.plans import model as M


def customers(spark, n=400):
    x = F.col("id").cast("double")
    features = [((x * (7 + i)) % (11 + i)).alias(c) for i, c in enumerate(C.FEATURE_COLS)]
    return spark.range(n).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 3 == 0).cast("int").alias("churn"), F.lit("x").alias("other"), *features)


def test_training_rows_are_read_back_without_the_joins_of_the_folds(spark, monkeypatch):
    """The operators since the last exchange are those whose metrics every task of a fit reports."""
    seen = []

    def kept(df, label, partitions=None):
        seen.append(df)
        return placed(df, label, partitions)

    placed = M._training_frame
    monkeypatch.setattr(M, "_training_frame", kept)
    M.fit_calibrated(customers(spark), FAST, folds=2, with_logistic=False)
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "Scan parquet" in plan and "Join" not in plan and "Window" not in plan
    assert set(seen[0].columns) == {"customer_id", "churn", "_cf", *C.FEATURE_COLS}  # no column that no fit reads
    assert seen[0].count() == 400 and {r["_cf"]: r["count"] for r in seen[0].groupBy("_cf").count().collect()} == {0: 200, 1: 200}


def test_fits_side_by_side():
    gate = threading.Barrier(3, timeout=30)  # opens only when all three run
    assert M.at_once(lambda: (gate.wait(), "a")[1], lambda: (gate.wait(), "b")[1], lambda: (gate.wait(), "c")[1]) == ["a", "b", "c"]


def test_partitions_of_a_fit_follow_its_rows_and_company():
    """Fits side by side fill the cores together, so each takes few tasks, which all report to the driver."""
    assert [M.training_partitions(n) for n in (0, 100_000, 500_000, 500_001, 4_300_000)] == [1, 1, 1, 2, 9]
    assert [M.training_partitions(n, alone=True) for n in (0, 100_000, 500_000, 4_300_000)] == [1, 1, 5, 43]
