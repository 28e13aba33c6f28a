"""Q4, Q5, A5 from kept aggregates: minutes, hours and days of verdicts.

Every batch appends what it adds to the minutes, hours and days its rows fall in, however old they are; reading
sums the parts, so late rows need no rewrite. A range is answered from whole days, whole hours and minutes at its
edges, and from rows only where it begins or ends inside a minute. Counts and sums are whole numbers, so
the results equal those from rows. Distinct attackers are kept as mergeable sketches.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import risk
from packetloom.operators import logs

#: Level and its width in seconds, coarse to fine; each is a whole number of the next.
LEVELS = {"day": 86_400, "hour": 3_600, "minute": 60}
SUMS = ("total", "safe", "suspicious", "dangerous", "score")
#: Registers of a sketch as a power of two: the relative standard error is 1.04 / sqrt(2 ** 12), 1.6 percent.
SKETCH_BITS = 12
_MICRO = 1_000_000


def _added(rows: DataFrame, seconds: int, ts: str) -> DataFrame:
    """Counts, score sums and attacker sketches of the buckets that rows fall in; rows without a time have a null one."""
    label = risk.known_class(F.col("classification"))
    score = risk.trend_score(F.col("ai_score"), F.col("risk_score"), F.col("classification"))
    bad = F.when((label == "dangerous") & (F.col("src_ip") != ""), F.col("src_ip"))
    bucket = (F.floor(F.col(ts) / seconds) * seconds).cast("bigint")
    return rows.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("total"),
        *[F.count(F.when(label == c, 1)).alias(c) for c in ("safe", "suspicious", "dangerous")],
        F.sum(F.round(score * _MICRO).cast("bigint")).alias("score"),
        F.hll_sketch_agg(bad, SKETCH_BITS).alias("attackers"),
    )


def add_batch(rows: DataFrame, path: str, batch_id: int, ts: str = "ts_sec") -> None:
    """Write what a batch adds at every level; a batch that runs again replaces its own part.

    ``rows`` has the event time, src_ip, classification, ai_score and risk_score. Coarser levels are summed from minutes.
    """
    spark = rows.sparkSession
    _added(rows, LEVELS["minute"], ts).write.mode("overwrite").parquet(f"{path}/minute/batch={batch_id}")
    fine = spark.read.parquet(f"{path}/minute/batch={batch_id}")
    for level in ("hour", "day"):
        width = LEVELS[level]
        _merged(fine.withColumn("bucket", F.col("bucket") - F.pmod("bucket", F.lit(width)))).write.mode(
            "overwrite"
        ).parquet(f"{path}/{level}/batch={batch_id}")


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.hll_union_agg("attackers").alias("attackers")
    )


def read_level(spark: SparkSession, path: str, level: str) -> DataFrame:
    """One row per bucket of a level that has rows."""
    return _merged(spark.read.parquet(f"{path}/{level}").drop("batch"))


def compact(spark: SparkSession, path: str) -> str:
    """The merged levels as a store of their own, which takes further batches; its path."""
    fresh = f"{path}-{uuid.uuid4().hex}"
    for level in LEVELS:
        read_level(spark, path, level).write.parquet(f"{fresh}/{level}/batch=-1")
    return fresh


def _cover(start: int, end: int) -> list[tuple[str, int, int]]:
    """(level, from, to) of whole buckets that make up [start, end), whole minutes both; at most two ranges a level."""
    ranges, left = [], [(start, end)]
    for level, width in LEVELS.items():
        rest = []
        for low, high in left:
            first, past = -(-low // width) * width, high // width * width
            if first < past:
                ranges.append((level, first, past))
                rest += [(low, first), (past, high)]
            else:
                rest.append((low, high))
        left = [r for r in rest if r[0] < r[1]]
    return ranges


def window_parts(spark: SparkSession, path: str, rows: DataFrame, start: float, end: float, ts: str = "ts_sec") -> DataFrame:
    """The kept buckets that make up a range of times, both ends included, and the rows at its ragged edges as buckets."""
    first, past = math.ceil(start / 60) * 60, int(end // 60) * 60
    if past < first:
        return _added(logs.between(rows, start, end, ts=ts), 60, ts)
    edges = logs.between(rows, start, end, ts=ts).where((F.col(ts) < first) | (F.col(ts) >= past))
    parts = [_added(edges, 60, ts)]
    for level, low, high in _cover(first, past):
        held = spark.read.parquet(f"{path}/{level}").drop("batch")
        parts.append(held.where((F.col("bucket") >= low) & (F.col("bucket") < high)))
    return reduce(DataFrame.unionByName, parts)


def window_totals(spark: SparkSession, path: str, rows: DataFrame, start: float, end: float, ts: str = "ts_sec") -> DataFrame:
    """Q4 from the kept levels: counts per class, exact, and the number of distinct attackers by their sketches."""
    return window_parts(spark, path, rows, start, end, ts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS[:-1]],
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("attackers")), F.lit(0)).alias("attackers_estimate"),
    )


def timeseries(spark: SparkSession, path: str, rows: DataFrame, start: float, end: float, digits: int | None = 4, ts: str = "ts_sec") -> DataFrame:
    """Q5 from kept minutes: counts per minute and class with the mean score, gaps filled with zeros."""
    first, past = int(start // 60) * 60, int(end // 60) * 60 + 60
    inner = spark.read.parquet(f"{path}/minute").where((F.col("bucket") > first) & (F.col("bucket") < past - 60))
    ragged = logs.between(rows, start, end, ts=ts).where((F.col(ts) < first + 60) | (F.col(ts) >= past - 60))
    held = inner.select("bucket", *SUMS).unionByName(_added(ragged, 60, ts).select("bucket", *SUMS))
    empty = logs.minute_buckets(rows, start, end).select("bucket", *[F.lit(0).cast("bigint").alias(c) for c in SUMS])
    summed = held.unionByName(empty).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in SUMS])
    mean = F.when(F.col("total") > 0, F.col("score") / _MICRO / F.col("total")).otherwise(0.0)
    return summed.select(
        "bucket", "safe", "suspicious", "dangerous", "total",
        (mean if digits is None else F.bround(mean, digits)).alias("avg_risk"),
    )


def counters(spark: SparkSession, path: str) -> DataFrame:
    """A5 from kept days: counts per class over all batches, as one row."""
    return spark.read.parquet(f"{path}/day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS[:-1]])
