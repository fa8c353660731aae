"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: NTZ timestamps are compared in UTC, AQE re-plans
# joins at runtime (broadcast only when the measured side is small, split skewed
# partitions, coalesce tiny ones).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "churnscope") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must name it. Only a local session without it
    gets a scratch folder, one a process and removed when the process ends.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _SCRATCH:
        _SCRATCH.append(tempfile.mkdtemp(prefix="churnscope-ckpt-"))
        atexit.register(shutil.rmtree, _SCRATCH[0], ignore_errors=True)
    return _SCRATCH[0]


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (keys per-application caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", "app")


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: lineage is cut, the data survives executor loss, and later
    scans get column pruning and filter pushdown. ``options`` go to the writer."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
               executor_cores_total: int = None, max_shuffle_partitions: int = 100_000) -> dict:
    """Session settings sized for an input of ``input_bytes`` on a cluster.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (never fewer than twice the total cores, at most
    ``max_shuffle_partitions`` to keep map-output tracking manageable), so a
    shuffle partition of line-level data fits in execution memory;
    AQE then coalesces small ones toward the same advisory size and splits
    skewed ones. Scan splits use the same target.
    """
    parts = min(max(1, -(-int(input_bytes) // target_partition_bytes)), max_shuffle_partitions)
    if executor_cores_total:
        parts = max(parts, 2 * executor_cores_total)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_conf(spark: SparkSession, conf: dict) -> None:
    for k, v in conf.items():
        spark.conf.set(k, v)
