"""Result-table sources and sinks, model persistence.

Results are published together. A run writes its tables into a folder of its
own, ``<out_dir>/_runs/<run>``, where no reader looks. When all are written, one
row with the run's tables and schemas is appended to ``<out_dir>/_published``:
one file, which the committer of Spark's writer moves into place. That row is the
switch: readers take the row with the highest number, so they see all of the
earlier set or all of the new one, and a run that fails leaves the earlier set.
Runs that are no longer among the latest ``keep`` are then removed; a reader that
has just opened the run before still finds its files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUBLISHED, RUNS = "_published", "_runs"
PUBLISHED_SCHEMA = "number long, run string, fmt string, tables array<struct<name: string, schema: string>>"


def _published(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The published runs, None where none is yet."""
    if not _exists(spark, f"{out_dir}/{PUBLISHED}"):
        return None
    return spark.read.schema(PUBLISHED_SCHEMA).json(f"{out_dir}/{PUBLISHED}")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def _runs(spark: SparkSession, out_dir: str) -> list[str]:
    fs, at = _file_system(spark, f"{out_dir}/{RUNS}")
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def current_run(spark: SparkSession, out_dir: str):
    """The row of the run that readers see, or None."""
    rows = _published(spark, out_dir)
    return rows.orderBy(F.desc("number"), "run").first() if rows is not None else None


def write_results(results: dict, out_dir: str, fmt: str = "parquet", keep: int = 2, extra=None) -> dict:
    """S3: publish the named DataFrames together as one run; returns the tables' paths.

    ``extra(folder)`` may write further files of the run (a model) before it is published."""
    if not results:
        return {}
    spark = next(iter(results.values())).sparkSession
    run = uuid.uuid4().hex
    folder = f"{out_dir}/{RUNS}/{run}"
    paths = {name: f"{folder}/{name}" for name in results}
    for name, df in results.items():
        w = df.write.mode("errorifexists")
        if fmt == "csv":
            w.option("header", True).csv(paths[name])
        else:
            w.format(fmt).save(paths[name])
    if extra:
        extra(folder)
    last = current_run(spark, out_dir)
    row = ((last["number"] if last else 0) + 1, run, fmt, [(name, df.schema.json()) for name, df in results.items()])
    spark.createDataFrame([row], PUBLISHED_SCHEMA).coalesce(1).write.mode("append").json(f"{out_dir}/{PUBLISHED}")
    remove_old(spark, out_dir, keep)
    return paths


def remove_old(spark: SparkSession, out_dir: str, keep: int = 2) -> list[str]:
    """Removes the folders of published runs but the latest ``keep``; runs still being written are left alone."""
    runs = [r["run"] for r in _published(spark, out_dir).orderBy(F.desc("number"), "run").select("run").collect()]
    gone = set(runs[keep:]) & set(_runs(spark, out_dir))
    for run in gone:
        fs, at = _file_system(spark, f"{out_dir}/{RUNS}/{run}")
        fs.delete(at, True)
    return sorted(gone)


def read_results(spark: SparkSession, out_dir: str, names=None, fmt: str = None) -> dict:
    """Read the published tables, all of the run or those named.

    The schemas are the ones written, so CSV needs no inference and ids keep their leading zeros."""
    row = current_run(spark, out_dir)
    if row is None:
        raise FileNotFoundError(f"no results are published in {out_dir}")
    fmt, folder = fmt or row["fmt"], f"{out_dir}/{RUNS}/{row['run']}"
    written = {t["name"]: T.StructType.fromJson(json.loads(t["schema"])) for t in row["tables"]}
    out = {}
    for name in names or written:
        r = spark.read.schema(written[name])
        out[name] = r.option("header", True).csv(f"{folder}/{name}") if fmt == "csv" else r.format(fmt).load(f"{folder}/{name}")
    return out


def results_folder(spark: SparkSession, out_dir: str) -> str:
    """The published run's folder (where its model lies)."""
    return f"{out_dir}/{RUNS}/{current_run(spark, out_dir)['run']}"


def save_model(model, path: str) -> str:
    """Persist a fitted Spark ML model (or our ensemble wrapper)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a model saved by ``save_model``."""
    from churnscope.plans.model import load_any
    return load_any(path)
