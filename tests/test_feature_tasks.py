"""Tasks of the customer level of the features follow the rows, not the bytes of a shuffle."""

import datetime

from churnscope.operators import features as FE

LINES = [(str(c), f"i{c}-{k}" if k % 5 else None, f"p{(c * k) % 7}", k % 4 + 1, datetime.datetime(2024, 1 + (c + k) % 9, 1 + (c * k) % 27, k), f"n{k % 3}", float(c + k))
         for c in range(60) for k in range(1, 9)]


def test_day_rows_bound_a_task_and_change_nothing(spark, monkeypatch):
    tx = spark.createDataFrame(LINES, "customer_id string, invoice string, stock_code string, quantity int, ts timestamp_ntz, country string, a double")
    tx = tx.selectExpr("customer_id", "invoice", "stock_code", "quantity", "ts", "country", "cast(a as decimal(18,2)) amount").cache()
    want = sorted(FE.customer_features(tx).collect())
    monkeypatch.setattr(FE, "DAY_ROWS", 20)
    dealt = FE.customer_features(tx)
    days = tx.selectExpr("customer_id", "date(ts) d").distinct().count()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-days // 20)}), REPARTITION_BY_NUM" in plan
    assert sorted(dealt.collect()) == want and len(want) == 60
    tx.unpersist()
