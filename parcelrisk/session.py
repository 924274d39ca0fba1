"""Session construction and shared-storage helpers.

A cluster names its shared folder in ``spark.checkpoint.dir``; every
intermediate table we write (checkpoints, staged CSV / zip files, run
outputs of the smoke queries) goes below it.  Only when the setting is
absent *and* the master is local (tests, laptop runs) do we create one under
``/tmp``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "parcelrisk",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session tuned for the operators in this package.

    AQE is on (partition coalescing, skew-join splitting, runtime broadcast
    conversion by measured size); the UI is off; time zone is UTC so that
    dates compare equal across engines.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # checkpoint files go when their DataFrame is no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Set a private one only when nothing is configured and the master is local.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster must name a shared folder")
        d = tempfile.mkdtemp(prefix="parcelrisk-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder; Spark's writers
    create it."""
    base = checkpoint_dir(spark)
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def recommended_conf(input_bytes: int, total_cores: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a job reading ``input_bytes`` on ``total_cores``.

    Shuffle partitions start at max(3 x cores, input / 256 MiB) and AQE
    coalesces them toward the advisory size, so small stages shrink and large
    ones stay spill-free; scans split files at the same size; skewed join
    partitions above 5 x the median (and 512 MiB) are split."""
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
