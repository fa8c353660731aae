"""Line breaks inside quoted CSV fields, across splits and blocks."""

import csv
import io
import random

import pytest

from churnscope.sources import records as R
from churnscope.sources.transactions import read_transactions

HEADER = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


def plain(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def written(rows, sep="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=sep).writerows([HEADER, *rows])
    return out.getvalue()


def some_rows(n, seed):
    r = random.Random(seed)
    odd = ["x", 'a "quoted" word', "two\nlines", '"', 'ends with quote"', "comma, and\n\nblank", '",\n"', "", "\n", 'a\n"b",c\nd']
    return [[str(k), f"S{k}", r.choice(odd), str(r.randrange(1, 9)), "2024-01-05 10:00:00", "2.50", str(r.randrange(5)), r.choice(odd[:4])] for k in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_lines", [1, 7, 1 << 16])
def test_records_across_blocks_and_splits(spark, tmp_path, monkeypatch, block_lines):
    texts = [written(some_rows(120, s)) for s in (1, 2)]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.csv").write_text(t, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")  # splits far smaller than a file
    try:
        lines = R.lines_of(spark, str(tmp_path))
        assert lines.select("file", "split").distinct().count() > 10 and R.has_breaks(lines)
        found = [r["record"] for r in R.records(lines, block_lines).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [r for t in texts for r in plain(t)]
    assert sorted(map(tuple, (r for x in found if x for r in plain(x)))) == sorted(map(tuple, want))


def test_transactions_keep_line_breaks(spark, tmp_path):
    rows = some_rows(60, 3)
    for sep, name in (("\n", "a.csv"), ("\r\n", "b.csv")):
        (tmp_path / name).write_text(written(rows, sep), newline="")
        df = read_transactions(spark, str(tmp_path / name))
        assert sorted((r["invoice"], r["country"] or "") for r in df.collect()) == sorted((r[0], r[7]) for r in rows)
        assert {str(r["quantity"]) for r in df.collect()} == {r[3] for r in rows}


def test_a_quote_inside_a_plain_field_opens_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",".join(HEADER) + '\n1,A,clock 3" wide,1,2024-01-05,2,11,UK\n2,A,"x\ny",1,2024-01-05,2,12,UK\n3,A,3" and 4",1,2024-01-05,2,13,UK\n')
    assert sorted(r["customer_id"] for r in read_transactions(spark, str(tmp_path / "t.csv")).collect()) == ["11", "12", "13"]


def test_an_unclosed_quote_is_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",".join(HEADER) + '\n1,A,"never closed,1,2024-01-05,2,11,UK\n2,A,x,1,2024-01-05,2,12,UK\n')
    with pytest.raises(ValueError, match="never closed"):
        read_transactions(spark, str(tmp_path / "t.csv")).collect()


def test_without_breaks_the_plain_reader_reads(spark, tmp_path):
    (tmp_path / "t.csv").write_text(written([r for r in some_rows(50, 4) if "\n" not in r[2] + r[7]]))
    assert not R.has_breaks(R.lines_of(spark, str(tmp_path)))
    a, b = (got(read_transactions(spark, str(tmp_path), line_breaks=x)) for x in (None, True))
    assert a == b and a
