"""Counters and upkeep of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.risk import known_class
from packetloom.operators.prefix import MINUTE_US, attach

COUNTERS = ("total", "safe", "suspicious", "dangerous")
DAY_S = 86_400


def counters(df: DataFrame) -> DataFrame:
    """A5: captured total and rows per class."""
    label = known_class(F.col("classification"))
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(label == c).alias(c) for c in COUNTERS[1:]],
    )


def distinct_members(df: DataFrame) -> DataFrame:
    """The members of the attacker, dangerous IP and dangerous URL sets, one per row."""
    bad = df.where(known_class(F.col("classification")) == "dangerous")
    ip, url = F.col("src_ip"), F.col("url")
    pairs = F.array(
        F.struct(F.lit("unique_attackers").alias("kind"), ip.alias("member")),
        F.struct(F.lit("dangerous_ips").alias("kind"), ip.alias("member")),
        F.struct(F.lit("dangerous_urls").alias("kind"), url.alias("member")),
    )
    return bad.select(F.inline(pairs)).where(F.col("member") != "").distinct()


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Sizes of those sets; ``approximate`` uses sketches (for streams)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    bad = known_class(F.col("classification")) == "dangerous"
    ip = F.when(bad & (F.col("src_ip") != ""), F.col("src_ip"))
    url = F.when(bad & (F.col("url") != ""), F.col("url"))
    return df.agg(
        count(ip).alias("unique_attackers"), count(ip).alias("dangerous_ips"),
        count(url).alias("dangerous_urls"),
    )


def snapshot(df: DataFrame) -> DataFrame:
    """The statistics row: counters and set sizes under id 1."""
    label = known_class(F.col("classification"))
    bad = label == "dangerous"
    ip = F.when(bad & (F.col("src_ip") != ""), F.col("src_ip"))
    url = F.when(bad & (F.col("url") != ""), F.col("url"))
    return df.agg(
        F.lit(1).alias("id"), F.count("*").alias("total"),
        *[F.count_if(label == c).alias(c) for c in COUNTERS[1:]],
        F.count_distinct(ip).alias("unique_attackers"),
        F.count_distinct(ip).alias("dangerous_ips"),
        F.count_distinct(url).alias("dangerous_urls"),
    )


def merge_counters(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pushed values replace stored ones; columns not pushed or NULL stay."""
    columns = [c for c in current.columns if c != "id"]
    both = current.withColumn("_pushed", F.lit(False)).unionByName(
        incoming.select("id", *[c for c in columns if c in incoming.columns], F.lit(True).alias("_pushed")),
        allowMissingColumns=True,
    )

    def value(name: str, pushed: bool) -> Column:
        return F.max(F.when(F.col("_pushed") == pushed, F.col(name)))

    return both.groupBy("id").agg(
        *[F.coalesce(value(c, True), value(c, False)).alias(c) for c in columns]
    )


def dangerous_batch(df: DataFrame, ts: str = "ts_sec") -> DataFrame:
    """Dangerous sources of a batch; reasons are those of the newest row."""
    bad = (known_class(F.col("classification")) == "dangerous") & (F.col("src_ip") != "")
    newest = F.struct(F.col(ts), F.col("id"))
    return df.where(bad).groupBy(F.col("src_ip").alias("ip_address")).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.count("*").alias("event_count"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk_score"),
        F.max_by("reasons", newest).alias("reasons"),
    )


def upsert_dangerous(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target merged with the result of dangerous_batch()."""
    return target.unionByName(batch).groupBy("ip_address").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count"),
        F.max("max_risk_score").alias("max_risk_score"),
        F.max_by("reasons", F.col("last_seen")).alias("reasons"),
    )


def retain(df: DataFrame, as_of: float, days: float = 7, ts: str = "ts_sec") -> DataFrame:
    """A10: rows young enough to keep; on a dated table old partitions are not read."""
    cutoff = as_of - days * DAY_S
    kept = df.where(F.col(ts) >= cutoff)
    if "event_date" in df.columns:
        kept = kept.where(F.col("event_date") >= F.timestamp_seconds(F.lit(cutoff)).cast("date"))
    return kept


def expired_counts(
    logs: DataFrame, history: DataFrame, cache: DataFrame, as_of: float, days: float = 7,
    ts: str = "ts_sec",
) -> DataFrame:
    """A10: rows each table loses, as (table, dropped)."""
    cutoff = as_of - days * DAY_S

    def lost(df: DataFrame, name: str, col: str, limit: float) -> DataFrame:
        return df.agg(F.count_if(F.col(col) < limit).alias("dropped")).select(
            F.lit(name).alias("table_name"), "dropped"
        )

    return (
        lost(logs, "packet_logs", ts, cutoff)
        .unionByName(lost(history, "ai_history", ts, cutoff))
        .unionByName(lost(cache, "ti_cache", "expires_at", as_of))
    )


def keep_persistable(df: DataFrame, persist_safe: bool = False) -> DataFrame:
    """Safe rows are stored only on request."""
    return df if persist_safe else df.where(
        F.coalesce(F.col("classification"), F.lit("safe")) != "safe"
    )


def systematic_sample(
    df: DataFrame, k: int = 4, keys: Sequence[str] = ("src_ip",), at: str = "ts_us",
    tiebreak: str = "packet_id", chunk: int = MINUTE_US,
) -> DataFrame:
    """Every ``k``-th row of each source, in time order."""
    ranked = attach(
        df, keys, at, sums={"_rank": F.lit(1).cast("long")}, tiebreak=tiebreak, chunk=chunk
    )
    return ranked.where(F.col("_rank") % k == 0).drop("_rank")


def training_sample(
    df: DataFrame, id_col: str, safe_rate: float = 0.02, pick: str | None = None
) -> DataFrame:
    """All flagged rows and a fixed share of safe ones, the same on every run.

    ``pick`` is an SQL expression in 0..9999 to use instead of a hash of the id.
    """
    place = F.expr(pick) if pick else F.pmod(F.xxhash64(id_col), F.lit(10_000))
    return df.where(
        (known_class(F.col("classification")) != "safe") | (place < int(safe_rate * 10_000))
    )
