"""Floods and port scans in sliding windows per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.prefix import MINUTE_US, Cut, attach, by_density, dealt, distinct_edges, leaving

SECOND_US = 1_000_000


def recent_counts(
    events: DataFrame, window_us: int, out: str = "recent", keys: tuple = ("src_ip",),
    at: str = "ts_us", chunk: int | None = MINUTE_US,
) -> DataFrame:
    """Events per key in the last ``window_us``, the event itself and its ties included."""
    one = F.lit(1).cast("long")
    return attach(
        events, keys, at, sums={out: one},
        edges=[leaving(events, list(keys), at, window_us, out, one)], chunk=chunk,
    )


def recent_distinct(
    events: DataFrame, item: str, window_us: int, out: str = "distinct_recent",
    keys: tuple = ("src_ip",), at: str = "ts_us", chunk: int | None = MINUTE_US,
) -> DataFrame:
    """Exact number of distinct items per key in the last ``window_us``."""
    edges = distinct_edges(events, list(keys), item, at, window_us, out, chunk)
    return attach(events, keys, at, sums={out: F.lit(0).cast("long")}, edges=[edges], chunk=chunk)


@by_density
def flood(
    packets: DataFrame, n: int = 120, window_s: float = 3, chunk: int | None = None
) -> DataFrame:
    """B1: more than ``n`` packets of a source in the window."""
    counted = recent_counts(packets, int(window_s * SECOND_US), "recent_packets", chunk=chunk)
    return counted.withColumn("is_flood", F.col("recent_packets") > n)


@by_density
def port_scan(
    packets: DataFrame, n: int = 15, window_s: float = 8, chunk: int | None = None
) -> DataFrame:
    """B2: at least ``n`` distinct destination ports of a source in the window."""
    counted = recent_distinct(
        packets, "dst_port", int(window_s * SECOND_US), "recent_ports", chunk=chunk
    )
    return counted.withColumn("is_port_scan", F.col("recent_ports") >= n)


def _distinct_in_rows(
    ranked: DataFrame, keys: list[str], rank: str, item: str, spans: dict[str, int], chunk: int, tasks: Cut = None
) -> DataFrame:
    """Distinct items among the newest n rows of a key, for each n of ``spans``.

    Rows are cut into ranges of ranks. The last n - 1 rows of a range are repeated at the
    head of the next, so every window holds at most chunk + n rows, whatever the key.
    """
    back = max(spans.values()) - 1
    chunk = max(chunk, back + 1)
    own = F.floor(F.col(rank) / chunk)
    ranges = F.array_distinct(F.array(own, F.floor((F.col(rank) + back) / chunk)))
    spread = dealt(ranked.withColumns({"_own": own, "_range": F.explode(ranges)}), tasks, *keys, "_range")
    frame = Window.partitionBy(*keys, "_range").orderBy(rank)
    counts = {
        name: F.size(F.collect_set(item).over(frame.rowsBetween(1 - n, 0))).cast("long")
        for name, n in spans.items()
    }
    return spread.withColumns(counts).where(F.col("_own") == F.col("_range")).drop("_own", "_range")


@by_density
def detect(
    packets: DataFrame, flood_n: int = 120, flood_s: float = 3, scan_n: int = 15,
    scan_s: float = 8, chunk: int | None = None, row_chunk: int = 10_000,
    history: int | None = None,
) -> DataFrame:
    """B3: 'port_scan', 'flood' or NULL per packet, whichever the newest packets show first.

    Going back in time, a scan wins when its ports are all among the newest ``flood_n``
    packets, which is before a flood can be counted; else a flood wins over a scan.
    ``history`` (B4) makes only the newest that many packets of a source count.
    """
    src, at = ["src_ip"], "ts_us"
    flood_us, scan_us = int(flood_s * SECOND_US), int(scan_s * SECOND_US)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    narrow = packets.select("packet_id", "src_ip", "ts_us", "dst_port")

    ranked = attach(
        packets, src, at, sums={"_rank": one}, tiebreak="packet_id", chunk=chunk, base=narrow
    )
    spans = {"_near_ports": flood_n} | ({"_kept_ports": history} if history else {})
    near = _distinct_in_rows(ranked, src, "_rank", "dst_port", spans, row_chunk, chunk)
    timed = attach(
        near, src, at, sums={"_flood": one, "_ports": none},
        edges=[
            leaving(narrow, src, at, flood_us, "_flood", one),
            distinct_edges(narrow, src, "dst_port", at, scan_us, "_ports", chunk),
        ],
        chunk=chunk, base=narrow,
    )
    ports = F.least("_ports", "_kept_ports") if history else F.col("_ports")
    flooding = F.col("_flood") > flood_n
    if history and history <= flood_n:
        flooding = F.lit(False)
    near_within = F.least(F.col("_near_ports"), F.col("_ports"))
    label = (
        F.when(flooding & (near_within >= scan_n), "port_scan")
        .when(flooding, "flood")
        .when(ports >= scan_n, "port_scan")
    )
    return timed.withColumn("behavior", label).drop(
        "_rank", "_near_ports", "_flood", "_ports", "_kept_ports"
    )
