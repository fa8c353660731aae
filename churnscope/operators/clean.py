"""Cleaning of raw transaction lines.

Keeps a line when it has a customer key, is not a cancellation (invoice
starting with ``C``; a missing invoice is kept), has positive quantity and
price, and a parseable date. Adds ``ts`` (timestamp_ntz) and the exact
decimal line ``amount``. All filters are plain predicates, so Catalyst pushes
the null and range checks into the parquet scan where the source allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts tried in order when the invoice date arrives as text.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy",
)


def canonical_id(c: Column) -> Column:
    """Trimmed string key; ``13085.0`` (a float-typed export) becomes ``13085``."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0$", "$1")


def parse_ts(df: DataFrame, col: str = "invoice_date") -> Column:
    """P5: parse the invoice date to timestamp_ntz; unparseable text gives null."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.col(col)
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return F.col(col).cast("timestamp_ntz")
    s = F.trim(F.col(col).cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])
    return parsed.cast("timestamp_ntz")


def is_cancelled(invoice: Column) -> Column:
    """Cancellation flag; a missing invoice is not a cancellation."""
    return F.coalesce(invoice.startswith("C"), F.lit(False))


def positive(c: Column, dtype: T.DataType) -> Column:
    """Strictly positive, and not NaN for floating columns (NaN > 0 is true in Spark)."""
    cond = c > 0
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        cond = cond & ~F.isnan(c)
    return cond


def clean(raw: DataFrame) -> DataFrame:
    """P1-P6 on raw lines; returns customer_id, invoice, stock_code, quantity,
    price, ts, amount (decimal(18,2)) and country when present."""
    has_country = "country" in raw.columns
    ts = parse_ts(raw)
    df = raw.select(
        canonical_id(F.col("customer_id")).alias("customer_id"),
        F.col("invoice").cast("string").alias("invoice"),
        F.col("stock_code").cast("string").alias("stock_code"),
        F.col("quantity"),
        F.col("price"),
        ts.alias("ts"),
        *([F.col("country").cast("string").alias("country")] if has_country else []),
    )
    q_type = raw.schema["quantity"].dataType
    p_type = raw.schema["price"].dataType
    df = df.filter(
        F.col("customer_id").isNotNull()
        & ~is_cancelled(F.col("invoice"))
        & positive(F.col("quantity"), q_type)
        & positive(F.col("price"), p_type)
        & F.col("ts").isNotNull()
    )
    if isinstance(p_type, T.DecimalType):
        kind = "decimal(18,2)" if p_type.scale <= 2 else f"decimal(28,{p_type.scale})"
        amount = (F.col("quantity").cast("decimal(10,0)") * F.col("price")).cast(kind)
    else:
        amount = (F.col("quantity") * F.col("price")).cast("double")
    return df.withColumn("amount", amount)


def dropped_lines(raw: DataFrame) -> DataFrame:
    """Lines that ``clean`` leaves out, counted by the first reason that applies."""
    ts = parse_ts(raw)
    reason = (F.when(F.col("customer_id").isNull(), "no customer")
              .when(is_cancelled(F.col("invoice").cast("string")), "cancelled")
              .when(~F.coalesce(positive(F.col("quantity"), raw.schema["quantity"].dataType), F.lit(False)), "quantity")
              .when(~F.coalesce(positive(F.col("price"), raw.schema["price"].dataType), F.lit(False)), "price")
              .when(ts.isNull(), "date"))
    return raw.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("lines")).filter("reason is not null")
