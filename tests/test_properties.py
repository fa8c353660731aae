"""Property test: cleaning + features equal the brute-force SQL definitions
on random transaction sets (null and cancelled invoices, bad quantities and
prices, repeated and sub-day timestamps, missing countries)."""

from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from churnscope import oracle_sql as O
from churnscope.operators import features as FE
from churnscope.operators.clean import clean
from tests.fixtures import SCHEMA

T0 = datetime(2023, 1, 1)

line = st.tuples(
    st.sampled_from(["A", "B", "C", " D ", "7.0", None]),
    st.one_of(st.none(), st.sampled_from(["1", "2", "3", "4", "C9", "C1"]), st.integers(10, 40).map(str)),
    st.sampled_from(["P1", "P2", "P3", None]),
    st.integers(-2, 6),
    st.sampled_from(["0.00", "1.50", "2.25", "9.99", "100.00"]),
    st.integers(0, 500 * 24 * 60).map(lambda m: (T0 + timedelta(minutes=m)).strftime("%Y-%m-%d %H:%M:%S")),
    st.sampled_from(["UK", "FR", "DE", None]),
)


def _oracle(con, pdf):
    con.register("tx_in", pdf)
    body = O.features_ctes("orders").split("refd AS", 1)[1]
    return con.execute("WITH tx AS (SELECT * FROM tx_in), refd AS" + body + " SELECT * FROM feat").df()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(line, min_size=1, max_size=60))
def test_features_match_sql(spark, rows):
    rows = [(c, i, s, q, Decimal(p), d, k) for c, i, s, q, p, d, k in rows]
    tx = clean(spark.createDataFrame(rows, SCHEMA)).cache()
    if tx.count() == 0:
        return
    got = {r["customer_id"]: r.asDict() for r in FE.customer_features(tx).collect()}
    con = duckdb.connect()
    exp = {r["customer_id"]: r for r in _oracle(con, tx.toPandas()).to_dict("records")}
    assert got.keys() == exp.keys()
    for cid in got:
        for c in O.FEATURE_LONGS + O.FEATURE_DOUBLES:
            assert got[cid][c] == pytest.approx(exp[cid][c], rel=1e-9, abs=1e-9), (cid, c)
    tx.unpersist()
