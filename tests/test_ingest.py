"""CSV ingest keeps valid lines; results keep their types; single features keep all customers."""

import pytest
from pyspark.sql import functions as F

from churnscope.operators import features as X
from churnscope.operators.clean import clean, dropped_lines
from churnscope.operators.summaries import probability_histogram
from churnscope.session import checkpoint_dir
from churnscope.sources.results import read_results, write_results
from churnscope.sources.transactions import read_transactions

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
LINES = [
    '1,A,"WHITE ""HEART"", LAMP",1,2024-01-05 10:00:00,2.00,11,UK',
    "2,A,x,1,2024-01-05 10:00:00,0.001,12,UK",
    "3,A,x,1000,2024-01-05 10:00:00,2.345,13,UK",
    "4,A,x,3.0,2024-01-05 10:00:00,1.00,14,UK",
    "5,A,x,1,2024-01-05T10:00:00,1.00,15,UK",
    "6,A,x,1,2024-01-05 10:00:00.123,1.00,16,UK",
    "7,A,x,1,2024-01-05 10:00,1.00,17.0,UK",
    "C8,A,x,1,2024-01-05 10:00:00,1.00,18,UK",
    "9,A,x,-1,2024-01-05 10:00:00,1.00,19,UK",
    "10,A,x,1,whenever,1.00,20,UK",
    "11,A,x,1,2024-01-05 10:00:00,1.00,,UK",
]


def test_csv_keeps_valid_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER + "\n".join(LINES) + "\n")
    raw = read_transactions(spark, str(tmp_path / "t.csv"))
    rows = {r["customer_id"]: float(r["amount"]) for r in clean(raw).collect()}
    assert rows == {"11": 2.0, "12": 0.001, "13": 2345.0, "14": 3.0, "15": 1.0, "16": 1.0, "17": 1.0}
    assert {r["reason"]: r["lines"] for r in dropped_lines(raw).collect()} == {"cancelled": 1, "quantity": 1, "date": 1, "no customer": 1}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_results_keep_types(spark, tmp_path, fmt):
    df = spark.createDataFrame([("00123", 1.5, 2), ("7", None, 3)], "customer_id string, p double, n long")
    write_results({"scores": df, "stats": df.select("n")}, str(tmp_path), fmt)
    back = read_results(spark, str(tmp_path), fmt=fmt)
    assert set(back) == {"scores", "stats"}
    assert back["scores"].dtypes == df.dtypes and sorted(back["scores"].collect()) == sorted(df.collect())


def test_single_features_keep_all_customers(spark):
    tx = spark.sql("SELECT 'a' customer_id, cast(null as string) invoice, cast(null as string) stock_code, 1 quantity, cast(1 as decimal(12,2)) price,"
                   " timestamp_ntz'2024-01-01 00:00:00' ts, cast(1 as decimal(18,2)) amount, cast(null as string) country")
    for f in (X.product_diversity, X.geo_spread, X.purchase_volatility, X.revenue_concentration):
        rows = f(tx).collect()
        assert len(rows) == 1 and rows[0][1] == 0


def test_histogram_has_empty_bins(spark):
    h = probability_histogram(spark.createDataFrame([(0.1,), (0.9,)], "churn_prob double"))
    assert h.count() == 50 and h.agg(F.sum("customers")).first()[0] == 2 and h.filter("tier_cut is not null").count() == 4


def test_scratch_folder_is_local_only(spark, monkeypatch):
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert checkpoint_dir(Session("local[4]")) == checkpoint_dir(Session("local"))
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(Session(master))
