"""A1-A4: burst alerts per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.risk import DANGEROUS
from packetloom.operators.behavior import SECOND_US, recent_counts
from packetloom.operators.prefix import MINUTE_US, attach
from packetloom.session import use_checkpoints


def is_eligible(label: Column, risk: Column, dangerous: float = DANGEROUS) -> Column:
    """A1: dangerous rows, and suspicious ones whose risk is as high."""
    low = F.lower(label)
    return F.coalesce((low == "dangerous") | ((low == "suspicious") & (risk >= dangerous)), F.lit(False))


def eligible(df: DataFrame, dangerous: float = DANGEROUS) -> DataFrame:
    """A1; rows without a source cannot burst."""
    return df.where(
        is_eligible(F.col("classification"), F.col("risk_score"), dangerous)
        & (F.coalesce(F.col("src_ip"), F.lit("")) != "")
    )


def burst_counts(df: DataFrame, window_s: int = 1200, chunk: int = MINUTE_US) -> DataFrame:
    """A2: eligible rows of the source in the rolling window, per eligible row."""
    return recent_counts(eligible(df), window_s * SECOND_US, "burst_count", chunk=chunk)


def debounce(
    candidates: DataFrame, gap_s: int = 600, key: str = "src_ip", at: str = "ts_us",
    chunk: int = MINUTE_US,
) -> DataFrame:
    """A3: the (key, at) that alert when an alert mutes its source for ``gap_s``.

    Whether a candidate alerts depends on all earlier ones, but its successor does not:
    it is the first candidate at least a gap later. A candidate with none inside the gap
    before it always alerts. So the alerts are what those starts reach over successor
    links, found by doubling the links: a chain of n alerts takes log2(n) joins on
    (key, at), whatever one source holds.
    """
    gap = gap_s * SECOND_US
    use_checkpoints(candidates.sparkSession)
    times = candidates.select(F.col(key).alias("k"), F.col(at).alias("t")).distinct()
    near = recent_counts(times, gap - 1, "_near", keys=("k",), at="t", chunk=chunk)
    linked = attach(
        near.withColumn("_back", -(F.col("t") + gap)), ["k"], "_back",
        mins={"next": F.lit(None).cast("long")},
        edges=[times.select("k", (-F.col("t")).alias("_at"), F.col("t").alias("next"))],
        chunk=chunk,
    )
    nodes = linked.select("k", "t", "next", (F.col("_near") == 1).alias("start")).checkpoint()
    starts = nodes.where("start").select("k", "t")
    # Links into a start are not needed, so every chain stays within one busy period.
    links = nodes.where(F.col("next").isNotNull()).select("k", "t", "next").join(
        starts.select("k", F.col("t").alias("next")), ["k", "next"], "left_anti"
    ).select("k", "t", "next")
    reached = starts
    while not links.isEmpty():
        reached = reached.unionByName(
            reached.join(links, ["k", "t"]).select("k", F.col("next").alias("t"))
        ).checkpoint()
        onward = links.select("k", F.col("t").alias("next"), F.col("next").alias("_far"))
        links = links.join(onward, ["k", "next"]).select(
            "k", "t", F.col("_far").alias("next")
        ).checkpoint()
    return reached.select(F.col("k").alias(key), F.col("t").alias(at))


def alert_reasons(
    alerts: DataFrame, events: DataFrame, window_s: int, first: int | None = None
) -> DataFrame:
    """A4: sorted distinct reasons in the window before each alert; the ``first`` if given.

    Events shrink to the first and last time of each reason per window-long bucket. An
    alert then needs two buckets: of the older one what ends inside its window, of its
    own what begins before it.
    """
    width = window_s * SECOND_US
    bucket = F.floor(F.col("ts_us") / width)
    seen = (
        events.select("src_ip", "ts_us", F.explode("reasons").alias("reason"))
        .select("src_ip", "ts_us", F.trim("reason").alias("reason"))
        .where(F.col("reason") != "")
        .groupBy("src_ip", bucket.alias("bucket"), "reason")
        .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    )
    wanted = alerts.select(
        "src_ip", "ts_us",
        F.explode(F.sequence(F.floor((F.col("ts_us") - width) / width), bucket)).alias("bucket"),
    )
    inside = (F.col("last_us") >= F.col("ts_us") - width) & (F.col("first_us") <= F.col("ts_us"))
    named = wanted.join(seen, ["src_ip", "bucket"]).where(inside).select("src_ip", "ts_us", "reason")
    reasons = F.array_sort(F.collect_set("reason"))
    named = named.groupBy("src_ip", "ts_us").agg(
        (reasons if first is None else F.slice(reasons, 1, first)).alias("reasons")
    )
    return alerts.join(named, ["src_ip", "ts_us"], "left").withColumn(
        "reasons", F.coalesce("reasons", F.array().cast("array<string>"))
    )


def burst_alerts(
    df: DataFrame, n: int = 10, window_s: int = 1200, gap_s: int = 600, first: int | None = None,
    chunk: int = MINUTE_US,
) -> DataFrame:
    """A1-A4: one row per alert with its event count and reasons."""
    counted = burst_counts(df, window_s, chunk).where(F.col("burst_count") > n)
    counts = counted.groupBy("src_ip", "ts_us").agg(F.max("burst_count").alias("burst_count"))
    fired = debounce(counts, gap_s, chunk=chunk).join(counts, ["src_ip", "ts_us"])
    return alert_reasons(fired, eligible(df), window_s, first)
