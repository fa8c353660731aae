"""P8 and P9 on stored indexes: search by part of an id, and lookup by id.

Search keeps a posting table: one row a (gram, id) for every run of ``GRAM``
letters in the lower-cased ids, range-dealt by gram, so a scan for a few grams
skips the files and row groups of all others. The grams that every match of a
pattern must hold are read off its literal runs; ids that hold all of them are
candidates, and the pattern itself then decides. A pattern without such a gram
(short runs, alternatives, classes, groups, escapes, letters beyond ASCII) is
searched by the full scan. Lookup keeps the customers range-dealt and sorted by
id with a Parquet bloom filter, so row groups are skipped by range and, for ids
that do not exist, by the filter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.operators.summaries import lookup_customer, search_customers
from churnscope.session import write_table

GRAM = 3


def _width(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gram_index(cust: DataFrame, gram: int = GRAM) -> DataFrame:
    """Stored: (gram, customer_id), each pair once; null ids and ids shorter than a gram have no rows."""
    low = F.lower("customer_id")
    starts = F.sequence(F.lit(1), F.length(low) - gram + 1)
    grams = F.array_distinct(F.transform(starts, lambda k: F.substr(low, k, F.lit(gram))))
    rows = cust.filter(F.length(low) >= gram).select("customer_id").distinct().select(F.explode(grams).alias("gram"), "customer_id")
    order = ["gram", "customer_id"]  # the id splits a gram that many ids hold
    return write_table(rows.repartitionByRange(_width(cust), *order).sortWithinPartitions(*order), "gram-index")


def needed_grams(search: str, literal: bool = False, gram: int = GRAM) -> list[str]:
    """Grams that every id matching ``search`` holds; none where that cannot be told from literal runs."""
    if not search.isascii() or (not literal and re.search(r"[\\|()\[\]{}]", search)):
        return []
    # a letter before * or ? need not be there; + ends a run but keeps its letter
    runs = [search] if literal else re.split(r".[*?]+|[.^$+]", search)
    return sorted({run[k:k + gram].lower() for run in runs for k in range(len(run) - gram + 1)})


def search_by_grams(cust: DataFrame, index: DataFrame, search: str, tier: str = None, literal: bool = False,
                    gram: int = GRAM) -> DataFrame:
    """Rows as ``search_customers`` gives; ``index`` is ``gram_index`` of the same customers and gram length."""
    need = needed_grams(search, literal, gram) if search else []
    if need:
        held = index.filter(F.col("gram").isin(need)).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
        cust = cust.join(held.filter(F.col("n") == len(need)).select("customer_id"), "customer_id", "left_semi").select(*cust.columns)
    return search_customers(cust, search, tier, literal)


def key_index(cust: DataFrame) -> DataFrame:
    """Stored: ``cust`` clustered by id, with a bloom filter a row group, sized by the ids it holds."""
    dealt = cust.repartitionByRange(_width(cust), "customer_id").sortWithinPartitions("customer_id")
    return write_table(dealt, "key-index", **{"parquet.bloom.filter.enabled#customer_id": "true",
                                              "parquet.bloom.filter.adaptive.enabled": "true"})


def lookup_by_key(index: DataFrame, customer_id: str) -> DataFrame:
    """The customer's rows; ``index`` is from ``key_index``."""
    return lookup_customer(index, customer_id)
