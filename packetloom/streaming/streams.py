"""Streams that Spark's own windowed aggregates express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import net, risk
from packetloom.operators.flows import FLOW_KEY

_CLASSES = ("safe", "suspicious", "dangerous")


def with_event_time(df: DataFrame, watermark: str, at: str = "ts_us") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(at)).withWatermark("event_time", watermark)


def deduplicated(df: DataFrame, watermark: str, id_col: str = "packet_id") -> DataFrame:
    """Drop repeats of an at-least-once source that arrive within the watermark."""
    return with_event_time(df, watermark).dropDuplicatesWithinWatermark([id_col])


def minute_counts(logs: DataFrame, watermark: str = "1 minute", at: str = "ts_us") -> DataFrame:
    """Q5 as a stream: counts per minute and class with the mean score."""
    label = risk.known_class(F.col("classification"))
    score = risk.trend_score(F.col("ai_score"), F.col("risk_score"), F.col("classification"))
    micro = F.round(score * 1_000_000).cast("long")
    return (
        with_event_time(logs, watermark, at)
        .groupBy(F.window("event_time", "1 minute").alias("w"))
        .agg(
            F.count("*").alias("total"), *[F.count_if(label == c).alias(c) for c in _CLASSES],
            F.sum(micro).alias("_sum"),
        )
        .select(
            F.unix_seconds("w.start").alias("bucket"), *_CLASSES, "total",
            (F.col("_sum") / 1_000_000 / F.col("total")).alias("avg_risk"),
        )
    )


def sliding_behavior(
    packets: DataFrame, watermark: str = "10 seconds", window: str = "8 seconds",
    slide: str = "1 second",
) -> DataFrame:
    """B12, alert grade: packets and approximate distinct ports per source and window.

    Partial aggregates merge before the shuffle, so a busy source is no hot key.
    windowed.detect_stream() is the exact form.
    """
    return (
        with_event_time(packets, watermark)
        .groupBy("src_ip", F.window("event_time", window, slide).alias("w"))
        .agg(F.count("*").alias("packets"), F.approx_count_distinct("dst_port").alias("ports"))
        .select("src_ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", "ports")
    )


def closed_flows(
    packets: DataFrame, idle: str = "2 minutes", watermark: str = "1 minute"
) -> DataFrame:
    """F2 as a stream: a flow ends after ``idle`` without packets."""
    def flag(letter: str) -> Column:
        return F.sum(net.flag_bit(F.col("tcp_flags"), letter))

    return (
        with_event_time(packets, watermark)
        .groupBy(*FLOW_KEY, F.session_window("event_time", idle).alias("w"))
        .agg(
            F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
            F.count("*").alias("packets"), F.sum("bytes").alias("bytes"),
            flag("S").alias("syn"), flag("A").alias("ack"), flag("R").alias("rst"),
            flag("F").alias("fin"), flag("P").alias("psh"),
        )
        .drop("w")
    )
