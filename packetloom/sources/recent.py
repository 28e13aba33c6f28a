"""The newest rows of a growing table, kept up batch by batch.

Each batch reads the kept rows and its own, takes the newest of both (heaps per task, then merged) and writes them as the
next version. The table itself is never read again. Readers take the last whole version, so they see all of
a batch or nothing of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from packetloom.operators import logs

#: Versions that stay for readers that began before the last ones were written.
STAY = 3


def _folder(spark: SparkSession, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose version is whole, oldest first."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    whole = [n for n in names if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("v")) for n in whole)


def add_batch(rows: DataFrame, path: str, batch_id: int, limit: int = 10_000, ts: str = "ts_sec") -> None:
    """Keep the ``limit`` newest of the kept rows and those of a batch; a batch that runs again replaces its version.

    Newest is by time, then id; rows without a time come last. The limit bounds what one task merges.
    """
    spark = rows.sparkSession
    held = versions(spark, path)
    earlier = [v for v in held if v < batch_id]
    if earlier:
        rows = spark.read.parquet(f"{path}/v{earlier[-1]}").unionByName(rows)
    logs.newest(rows, limit, ts).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
    for old in earlier[:-STAY]:
        files, where = _folder(spark, f"{path}/v{old}")
        files.delete(where, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The kept rows after the last batch, in no order; ``logs.newest`` sorts them."""
    held = versions(spark, path)
    if not held:
        raise ValueError(f"no batch was kept under {path}")
    return spark.read.parquet(f"{path}/v{held[-1]}")


def follow(stream: DataFrame, path: str, limit: int = 10_000, ts: str = "ts_sec") -> DataStreamWriter:
    """A sink of a stream of verdicts that keeps its newest rows under ``path``."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: add_batch(rows, path, batch_id, limit, ts))
