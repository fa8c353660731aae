"""Fits run side by side as far as their tasks fill the cores."""

import threading
import time

from pyspark.ml.classification import LogisticRegression

from churnscope.config import FAST
from churnscope.plans import model as M
from tests.test_fit_lineage import customers


def test_fits_follow_the_cores_and_the_rows(spark):
    cores, df = spark.sparkContext.defaultParallelism, spark.range(1)
    assert M.fits_at_once(df, 1000) == cores
    assert M.fits_at_once(df, 500_000 * 2) == -(-cores // 2)
    assert M.fits_at_once(df, 500_000 * 10 * cores) == 1


def test_cross_validation_keeps_to_that_over_all_folds(spark, monkeypatch):
    running, most, lock = [0], [0], threading.Lock()

    class Slow:
        def fit(self, df):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.2)
            try:
                return LogisticRegression(maxIter=2).fit(df)
            finally:
                with lock:
                    running[0] -= 1

    monkeypatch.setattr(M, "member_specs", lambda cfg, with_logistic=True: [(n, lambda rows: Slow(), 1.0) for n in ("a", "b", "c")])
    monkeypatch.setattr(M, "training_partitions", lambda n, alone=False: spark.sparkContext.defaultParallelism // 2)  # two fits fill the cores
    cv = M.cross_validate(customers(spark), FAST, folds=3)
    assert [r["fold"] for r in cv.orderBy("fold").collect()] == [0, 1, 2] and most[0] == 2
