"""Structured Streaming entry points.

The original application has no streaming code: it reads one file per run.
What carries over unchanged to streams is the stateless part of the job:
cleaning (P1-P6) and scoring (C1-C3, M12, M14) are row-wise, so the same
functions apply to a streaming DataFrame. ``ingest`` appends cleaned lines to
a parquet table with an exactly-once checkpoint, so the batch pipeline can
be rerun on the growing table; ``score_requests`` scores what-if requests as
they arrive. No state store is needed for either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from churnscope.operators.clean import clean
from churnscope.sources.adapters import events_to_transactions


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = None) -> DataFrame:
    """A file stream over one parquet table of a folder (schema from the table)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def clean_stream(raw_stream: DataFrame) -> DataFrame:
    """P1-P6 on a stream of raw transaction lines."""
    return clean(raw_stream)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned transaction lines from a stream of event rows."""
    return clean_stream(events_to_transactions(read_table_stream(spark, sf_dir, "events")))


def ingest(lines: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of cleaned lines to a parquet table (exactly once)."""
    w = lines.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def score_requests(requests_stream: DataFrame, cust: DataFrame, model, cfg=None) -> DataFrame:
    """M14 on a stream of requests (medians come from the batch customer table)."""
    from churnscope.config import DEFAULT
    from churnscope.plans.whatif import whatif_scores
    return whatif_scores(requests_stream, cust, model, cfg or DEFAULT)
