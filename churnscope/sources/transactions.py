"""The transaction-line source and its fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw columns as they appear in a transaction export (before cleaning).
RAW_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("invoice", T.StringType(), True),
    T.StructField("stock_code", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("price", T.DecimalType(18, 6), True),
    T.StructField("invoice_date", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])

# Header names of the original CSV export, mapped to ours.
CSV_HEADER = {
    "Customer ID": "customer_id",
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Quantity": "quantity",
    "Price": "price",
    "InvoiceDate": "invoice_date",
    "Country": "country",
}

# Strings a CSV reader should treat as a missing value in key columns.
CSV_NULL_TOKENS = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "None", "<NA>")


CSV_OPTIONS = {"encoding": "UTF-8", "escape": '"'}


def _csv_records(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """Text columns of CSV whose quoted fields hold line breaks."""
    from churnscope.sources.records import records

    names = spark.read.option("header", True).options(**CSV_OPTIONS).csv(path).columns
    fields = F.from_csv("record", ", ".join(f"`{c}` string" for c in names), CSV_OPTIONS)
    # exploded, so that no filter on the columns moves below the parsing, which it would repeat for each column it names
    rows = records(lines).filter(F.length("record") > 0).select("split", F.explode(F.array(fields)).alias("r"))
    # every file begins with the header
    header = F.array(*(F.coalesce(F.col(f"r.`{c}`"), F.lit("")) for c in names)) == F.array(*map(F.lit, names))
    return rows.filter(~((F.col("split") == 0) & header)).select("r.*")


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", line_breaks: bool = None) -> DataFrame:
    """Read transaction lines from CSV (with the export's header names) or parquet.

    No inference pass runs: all CSV columns arrive as strings, a doubled quote
    inside a quoted field is a quote, and prices keep six decimals. ``clean``
    parses and types the columns. Line breaks inside quoted fields are kept, and
    files split all the same (``sources.records``). ``line_breaks`` says whether
    there are any; left out, one scan of the lines tells.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.withColumnsRenamed({k: v for k, v in CSV_HEADER.items() if k in df.columns})
    from churnscope.sources.records import has_breaks, lines_of

    lines = lines_of(spark, path)
    if has_breaks(lines) if line_breaks is None else line_breaks:
        df = _csv_records(spark, path, lines)
    else:
        df = spark.read.option("header", True).option("multiLine", False).options(**CSV_OPTIONS).csv(path)
    renamed = df.withColumnsRenamed({k: v for k, v in CSV_HEADER.items() if k in df.columns})
    cols = []
    for f in RAW_SCHEMA.fields:
        if f.name in renamed.columns:
            c = F.col(f.name)
            if f.name == "customer_id":
                c = F.when(F.trim(c).isin(*CSV_NULL_TOKENS), None).otherwise(c)
            elif f.name == "quantity":
                c = F.expr("CASE WHEN try_cast(quantity as decimal(20,6)) = floor(try_cast(quantity as decimal(20,6)))"
                           " THEN try_cast(try_cast(quantity as decimal(20,6)) as int) END")
            elif f.name == "price":
                c = F.expr("try_cast(price as decimal(18,6))")
            cols.append(c.alias(f.name))
    return renamed.select(*cols)
