"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.session import checkpoint_dir, write_table

__all__ = ["WORD", "drop_clashing", "new_folder", "packed", "read", "released", "shuffle_width", "stored_steps", "unpacked", "word_count", "write_table"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns whose names (case ignored) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, ``_in``, so that an operator's own names cannot meet the caller's."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_in")


def unpacked(df: DataFrame) -> list[Column]:
    """The columns of ``df`` out of the struct that ``packed`` made of them."""
    return [F.col(f"_in.`{c}`").alias(c) for c in df.columns]


#: What operators keep in a worker process between tasks: owner and a function that forgets it.
KEPT: list[tuple[str, Callable]] = []


def released(run: Callable, owner: str = "") -> Callable:
    """``run`` for mapInArrow. What other operators than ``owner`` keep in the worker is forgotten first, and what is no
    longer used is given back to the system at the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        for other, forget in KEPT:
            if other != owner:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU library only
            if trim:
                trim(0)

    return wrapped


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


#: Settings that bound what a task holds of its rows on the way to Python.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def stored_steps(spark: SparkSession) -> Iterator[None]:
    """Settings for jobs whose steps are all stored tables: Spark removes a query's shuffle files when the query ends,
    and hands rows to Python in batches small by rows and by bytes (a thousand long sets are 160 MB)."""
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **SMALL_BATCHES}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
