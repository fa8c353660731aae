import pytest

from churnscope.operators.clean import clean
from churnscope.operators.features import (
    baseline_features, churn_label, customer_features, with_clv,
)
from tests.fixtures import EXPECTED, IDS, raw_df


def _rows(df):
    return {r["customer_id"]: r.asDict() for r in df.collect()}


def test_clean_keeps_ten_lines(spark):
    tx = clean(raw_df(spark))
    assert tx.count() == 10
    assert sorted(r[0] for r in tx.select("customer_id").distinct().collect()) == list(IDS)


def test_micro_fixture_features(spark):
    tx = clean(raw_df(spark))
    cust = with_clv(churn_label(customer_features(tx)))
    got = _rows(cust)
    for feat, vals in EXPECTED.items():
        if feat == "trend":
            continue
        for cid, v in zip(IDS, vals):
            assert got[cid][feat] == pytest.approx(v, abs=1e-6), (feat, cid)


def test_micro_fixture_baseline_trend(spark):
    tx = clean(raw_df(spark))
    got = _rows(baseline_features(tx))
    for cid, v in zip(IDS, EXPECTED["trend"]):
        assert got[cid]["trend"] == pytest.approx(v, abs=1e-6)
    assert got["N"]["avg_order_value"] == float("inf")


def test_geo_spread_without_country(spark):
    tx = clean(raw_df(spark, with_country=False))
    got = _rows(customer_features(tx))
    assert all(got[c]["geo_spread"] == 1 for c in IDS)
