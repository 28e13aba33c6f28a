"""Verdicts on addresses from connection, notice and weird logs.

Columns are those of the logs with id.orig_h, id.resp_h, id.orig_p and id.resp_p renamed
to orig_h, resp_h, orig_p and resp_p. ``order`` is the column that gives log order: the time,
for connection ids are random and often unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of notice names that mean danger.
RISKY_NOTES = (
    "scan", "brute", "attack", "exploit", "malware", "dos", "ddos", "infection", "sql", "shell",
)
SALTS = 64


def newest_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key, exact for keys of any size.

    Each of 64 parts of a key keeps its newest n; only those meet in one task.
    """
    def best(rows: DataFrame, *by: str) -> DataFrame:
        ranked = Window.partitionBy(*by).orderBy(F.desc(order), F.desc("_part"))
        return rows.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= n).drop("_n")

    parted = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    return best(best(parted, key, "_part"), key).drop("_part")


def by_endpoint(conn: DataFrame, cap: int | None = None, order: str = "ts") -> DataFrame:
    """Each connection under both of its ends; only the newest ``cap`` per address if given."""
    ends = F.array_distinct(F.array_compact(F.array("orig_h", "resp_h")))
    rows = conn.withColumn("ip", F.explode(ends)).where(F.col("ip") != "")
    return rows if cap is None else newest_per_key(rows, "ip", order, cap)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def conn_profile(ends: DataFrame) -> DataFrame:
    """Score and signals per address from the rows of by_endpoint()."""
    state, proto = F.upper(F.coalesce("conn_state", F.lit(""))), F.lower(F.coalesce("proto", F.lit("")))
    rejected = state.contains("REJ") | (F.floor(F.abs(_number(F.col("resp_bytes")))) == 0)
    short = (_number(F.col("duration")) < 0.5) & proto.isin("tcp", "udp")
    syn_only = (state == "SH") | state.startswith("S0")
    counts = ends.groupBy("ip").agg(
        F.count("*").alias("conns"), F.count_if(rejected).alias("rejected"),
        F.count_if(short).alias("short_lived"), F.count_if(syn_only).alias("syn_only"),
        F.count_distinct(F.nullif("resp_p", F.lit(""))).alias("resp_ports"),
    )
    mostly = F.col("rejected") / F.col("conns") > 0.5
    many = ~mostly & (F.col("rejected") > 5)
    scan = F.col("resp_ports") >= 15
    several = ~scan & (F.col("resp_ports") >= 8)
    brief, syn = F.col("short_lived") > 10, F.col("syn_only") > 8
    signs = (
        (mostly, "zeek_high_reject_ratio", 0.7), (many, "zeek_many_rejected_conns", 0.55),
        (scan, "zeek_port_scan", 0.75), (several, "zeek_many_target_ports", 0.5),
        (brief, "zeek_short_connections", 0.45), (syn, "zeek_syn_scan_pattern", 0.6),
    )
    return counts.withColumns(
        {
            "score": F.greatest(*[F.when(test, value).otherwise(0.0) for test, _, value in signs]),
            "signals": F.array_compact(F.array(*[F.when(test, name) for test, name, _ in signs])),
        }
    )


def _addresses(log: DataFrame) -> DataFrame:
    """One row per address field of a log row; an address in two fields counts twice."""
    fields = [c for c in ("orig_h", "resp_h", "src", "dst") if c in log.columns]
    return log.withColumn("ip", F.explode(F.array_compact(F.array(*fields)))).where(
        ~F.col("ip").isin("", "-")
    )


def notices(log: DataFrame, cap: int | None = None, order: str = "ts") -> DataFrame:
    """Z3: score and signals per address from all its notices, or its newest ``cap``.

    Each risky notice name is a signal, once, in the order of its first notice.
    """
    note = F.lower(F.coalesce(F.nullif("note", F.lit("")), F.col("msg"), F.lit("")))
    hits = _addresses(log).select("ip", F.col(order).alias("_order"), note.alias("note"))
    if cap is not None:
        hits = newest_per_key(hits, "ip", "_order", cap)
    names = hits.groupBy("ip", "note").agg(F.count("*").alias("n"), F.min("_order").alias("at"))
    risky = F.col("note").rlike("|".join(RISKY_NOTES))
    signal = F.struct("at", F.concat(F.lit("zeek_notice_"), "note").alias("signal"))
    found = names.groupBy("ip").agg(
        F.sum("n").alias("notices"),
        F.array_sort(F.collect_list(F.when(risky, signal))).alias("_risky"),
    )
    any_risky = F.size("_risky") > 0
    return found.select(
        "ip", "notices", F.when(any_risky, 0.85).otherwise(0.4).alias("score"),
        F.when(any_risky, F.transform("_risky", lambda r: r["signal"]))
        .otherwise(F.array(F.lit("zeek_notice_activity"))).alias("signals"),
    )


def weird(log: DataFrame) -> DataFrame:
    """Score and signals per address from the number of odd events."""
    counts = _addresses(log).groupBy("ip").agg(F.count("*").alias("weird"))
    heavy = F.col("weird") > 20
    return counts.withColumns(
        {
            "score": F.when(heavy, 0.7).when(F.col("weird") > 5, 0.5).otherwise(0.35),
            "signals": F.array_compact(
                F.array(F.lit("zeek_weird_activity"), F.when(heavy, "zeek_heavy_weird"))
            ),
        }
    )


def zeek_verdict(
    conn: DataFrame | None = None, notice: DataFrame | None = None,
    weird_log: DataFrame | None = None, cap: int | None = None, order: str = "ts",
) -> DataFrame:
    """One verdict per address seen in any log."""
    parts = []
    sources = (
        (0, conn, lambda df: conn_profile(by_endpoint(df, cap, order))),
        (1, notice, lambda df: notices(df, cap, order)),
        (2, weird_log, weird),
    )
    for rank, log, profile in sources:
        if log is not None:
            parts.append(profile(log).select("ip", F.lit(rank).alias("rank"), "score", "signals"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    fused = rows.groupBy("ip").agg(
        F.max("score").alias("score"),
        F.min("rank").alias("_first"),
        F.array_sort(F.collect_list(F.struct("rank", "signals"))).alias("_parts"),
    )
    bad, odd = F.col("score") >= 0.7, F.col("score") >= 0.4
    return fused.select(
        "ip",
        F.when(bad, "malicious").when(odd, "suspicious")
        .when(F.col("_first") < 2, "safe").otherwise("unknown").alias("verdict"),
        "score",
        F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["signals"]))).alias("signals"),
        F.when(bad, "zeek_flag_dangerous").when(odd, "zeek_flag_suspicious").alias("reason"),
    )
