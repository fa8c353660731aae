"""Micro fixture: 15 raw lines covering the cleaning edge cases."""

from decimal import Decimal

from pyspark.sql import types as T

RAW = [
    ("A", "1001", "P1", 2, "5.00", "2024-01-05 10:00:00", "UK"),
    ("A", "1001", "P2", 1, "5.00", "2024-01-05 10:00:00", "UK"),
    ("A", "1002", "P1", 1, "7.00", "2024-03-20 09:00:00", "FR"),
    ("A", "1003", "P3", 2, "4.00", "2024-04-01 00:00:00", "UK"),
    ("A", "1004", "P3", 3, "3.00", "2024-05-02 12:00:00", "UK"),
    ("B", "2001", "P1", 1, "3.00", "2024-01-03 08:00:00", "UK"),
    ("B", "2002", "P1", 2, "3.00", "2024-02-03 08:00:00", "UK"),
    (" B ", "2003", "P1", 3, "3.00", "2024-03-05 08:00:00", "UK"),
    ("Z", "3001", "P9", 1, "4.00", "2024-01-01 00:00:00", "DE"),
    ("N", None, "P1", 1, "6.00", "2024-04-15 00:00:00", "UK"),
    ("A", "C1005", "P1", 5, "5.00", "2024-05-03 10:00:00", "UK"),
    (None, "4001", "P1", 1, "5.00", "2024-05-03 10:00:00", "UK"),
    ("A", "1006", "P1", -1, "5.00", "2024-05-03 10:00:00", "UK"),
    ("A", "1007", "P1", 1, "0.00", "2024-05-03 10:00:00", "UK"),
    ("A", "1008", "P1", 1, "5.00", "not a date", "UK"),
]

SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("invoice", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DecimalType(12, 2)),
    T.StructField("invoice_date", T.StringType()),
    T.StructField("country", T.StringType()),
])

EXPECTED = {
    # feature: (A, B, N, Z)
    "recency": (1, 59, 18, 123),
    "frequency": (4, 3, 0, 1),
    "monetary": (39, 18, 6, 4),
    "avg_order_value": (9.75, 6, 0, 4),
    "product_diversity": (3, 1, 1, 1),
    "total_quantity": (9, 6, 1, 1),
    "geo_spread": (2, 1, 1, 1),
    "purchase_volatility": (3.593976, 3, 0, 0),
    "avg_days_between_purchases": (29, 31, 0, 0),
    "spending_trend": (-0.4, 3, 0, 0),
    "revenue_concentration": (0.275477, 0.388889, 0, 1),
    "spend_last30": (9, 0, 6, 0),
    "spend_30_90": (15, 9, 0, 0),
    "recency_acceleration": (0.625, 0, 0, 0),
    "weekend_ratio": (0, 0.333333, 0, 0),
    "tenure": (119, 121, 18, 123),
    "clv": (9.75, 4.5, 1.5, 1),
    "trend": (0, 0.75, 0, 0),
    "churn": (0, 0, 0, 1),
}
IDS = ("A", "B", "N", "Z")


def raw_df(spark, with_country=True):
    rows = [(c, i, s, q, Decimal(p), d, k) for c, i, s, q, p, d, k in RAW]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if with_country else df.drop("country")
