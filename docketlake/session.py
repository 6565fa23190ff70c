"""Session settings the engine relies on."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch between Spark and Python, and the setting; Spark's default is 10,000 rows, whatever their texts hold.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(master: str | None = None, name: str = "docketlake", shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC timestamps, AQE with skew handling and Arrow transfer."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Rows here are whole texts and vectors, of which a task holds a batch on both sides; a setting other than Spark's default stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions find it there."""
    bound_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_docketlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="docketlake-"), "docketlake.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    sc.addPyFile(target)
    sc._docketlake_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that later reads see the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
