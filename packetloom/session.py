"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import packetloom

# Helpers of the few Python UDFs travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(packetloom)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results or plans depend on.

    Times are UTC everywhere. AQE splits skewed joins and coalesces small shuffle
    partitions, so the shuffle partition count of the session may be set for the
    largest stage. A batch for Python is bounded in bytes too, as payloads differ in size.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (tests)
    falls back to a fresh folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="packetloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoints(spark: SparkSession) -> None:
    """Point Spark's reliable checkpoints at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
