"""CSV files with line breaks: headers go, and a record is parsed once whatever is asked of its columns."""

from pyspark.sql import functions as F

from churnscope.sources import transactions as T
from churnscope.sources.records import lines_of

HEADER = "Customer ID,Invoice,StockCode,Quantity,Price,InvoiceDate,Country"
ROW = '1,i1,s1,2,3.5,2024-01-01 00:00:00,"a\nb"'


def test_headers_go_and_rows_that_quote_them_stay(spark, tmp_path):
    quoted = ",".join(f'"{c}"' for c in HEADER.split(","))
    near = f'2,"{HEADER}",s2,1,1.0,2024-01-02 00:00:00,x'  # holds every name, and is a row
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{ROW}\n{near}\n")
    (tmp_path / "b.csv").write_text(f"{quoted}\r\n{ROW}\r\n{HEADER}\r\n")
    df = T._csv_records(spark, str(tmp_path), lines_of(spark, str(tmp_path)))
    assert sorted(r["Invoice"] for r in df.collect()) == sorted([HEADER, "i1", "i1"])
    assert {r["Country"] for r in df.collect()} == {"a\nb", "x"}
    asked = T.read_transactions(spark, str(tmp_path)).filter("quantity > 0 and price > 0 and customer_id is not null")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    parsing = [x for x in plan.splitlines() if "from_csv" in x]  # a branch of whole lines and one of joined ones
    assert parsing and all("Generate explode" in x and x.count("from_csv") == 1 for x in parsing)
    assert asked.count() == 3


def test_a_name_with_a_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a""b",c\n1,"x\ny"\n')
    df = T._csv_records(spark, str(tmp_path), lines_of(spark, str(tmp_path)))
    assert [tuple(r) for r in df.select(*(F.col(f"`{c}`") for c in df.columns)).collect()] == [("1", "x\ny")]
