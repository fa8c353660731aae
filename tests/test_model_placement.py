"""Fits depend on the customers and the seed, not on the session's parallelism."""

import pytest

from churnscope import queries as Q
from churnscope.config import FAST
from churnscope.plans import explain as X
from churnscope.plans import model as M
from churnscope.plans import segments as S
from tests.conftest import SF001


def test_shuffle_partitions_do_not_change_the_models(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TRAINING_PARTITION", 40)  # four partitions of the 150 customers
    cust = Q.cust_of(spark, SF001)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            dealt = cust.repartition(n)
            probs = {r["customer_id"]: r["churn_prob"] for r in M.fit_calibrated(dealt, FAST).transform(cust).collect()}
            _, gbt = X.fit_explainer(dealt, FAST)
            _, km = S.fit_segments(dealt, FAST)
            found.append((probs, gbt.toDebugString.split("\n", 1)[1], km.clusterCenters()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    one, many = found
    assert one[0] == pytest.approx(many[0], abs=1e-9)
    assert one[1] == many[1]
    assert [list(c) for c in one[2]] == [pytest.approx(list(c), abs=1e-9) for c in many[2]]
