"""Registered queries: stored verdicts read through indexes, kept aggregates and a kept cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from packetloom.operators import logs, maintain, rollups
from packetloom.plans.adapters import adapt, table
from packetloom.plans.log_queries import _IN_RANGE, _LABEL, _SERIES, DAY_S, END, NOW, START, _counts, _logs
from packetloom.plans.registry import query
from packetloom.session import shared_dir
from packetloom.sources import page_index, recent, search_index, tables, training


def _base(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("q20_indexed_text", ("logs",), """
SELECT id, src_ip FROM logs WHERE contains(lower(url), 'h3.example') OR list_contains(reasons, 'h3.example')
""")
def q20_indexed_text(spark, sf_dir):
    """A table that grows after it was indexed once; its files hold a few hosts each."""
    base, rows = _base(spark), _logs(spark, sf_dir)
    for half in range(2):
        grown = rows.where(F.col("id") % 2 == half).repartitionByRange(8, "url")
        grown.write.mode("append").parquet(f"{base}/logs")
        search_index.add_files(spark, f"{base}/logs", f"{base}/index")
    return search_index.free_text(spark, f"{base}/logs", f"{base}/index", " H3.Example").select("id", "src_ip")


def _kept(spark, sf_dir):
    """Aggregates of three batches that each hold rows of all times."""
    base, rows = _base(spark), _logs(spark, sf_dir)
    for batch in range(3):
        rollups.add_batch(rows.where(F.col("id") * 7919 % 3 == batch), base, batch)
    return base, rows


@query("q4_rollup_totals", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs {_IN_RANGE}) SELECT count(*) AS total, {_counts()}, true AS near FROM l
""")
def q4_rollup_totals(spark, sf_dir):
    """Counts from days, hours and minutes; the sketch of distinct attackers lies near the exact number."""
    base, rows = _kept(spark, sf_dir)
    exact = logs.window_totals(rows, START, END).select("unique_attackers")
    found = rollups.window_totals(spark, base, rows, START, END)
    near = F.abs(F.col("attackers_estimate") - exact.scalar()) <= 0.06 * exact.scalar()
    return found.withColumn("near", near).drop("attackers_estimate")


@query("q5_rollup_series", ("logs",), _SERIES + "SELECT * FROM series")
def q5_rollup_series(spark, sf_dir):
    base, rows = _kept(spark, sf_dir)
    return rollups.timeseries(spark, base, rows, START, END, digits=None)


@query("a5_rollup_counters", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs) SELECT count(*) AS total, {_counts()} FROM l
""")
def a5_rollup_counters(spark, sf_dir):
    base, _ = _kept(spark, sf_dir)
    return rollups.counters(spark, base)


@query("q24_deep_page", ("logs",), """
SELECT id, src_ip, url FROM logs ORDER BY src_ip, id DESC OFFSET 900 LIMIT 50
""")
def q24_deep_page(spark, sf_dir):
    """A page far behind, from the one or two ranges of the sort order that hold it."""
    base = _base(spark)
    page_index.build(_logs(spark, sf_dir), base, "src_ip", "asc", range_rows=300)
    return page_index.page(spark, base, 19, 50).select("id", "src_ip", "url")


@query("q3_deep_page", ("logs",), """
SELECT id, ts_sec, src_ip FROM logs ORDER BY ts_sec DESC, id DESC OFFSET 800 LIMIT 100
""")
def q3_deep_page(spark, sf_dir):
    base = _base(spark)
    page_index.build(_logs(spark, sf_dir), base, "ts_sec", "desc", range_rows=300)
    return page_index.page(spark, base, 9, 100).select("id", "ts_sec", "src_ip")


@query("s13_kept_cache", ("logs",), "SELECT id, src_ip FROM logs ORDER BY ts_sec DESC, id DESC LIMIT 500")
def s13_kept_cache(spark, sf_dir):
    """The newest rows kept up over three batches that each hold rows of all times."""
    base, rows = _base(spark), _logs(spark, sf_dir)
    for batch in range(3):
        recent.add_batch(rows.where(F.col("id") * 7919 % 3 == batch), base, batch, limit=500)
    return recent.read(spark, base).select("id", "src_ip")


@query("a10_purge_batches", ("logs",), f"""
SELECT id, ts_sec, src_ip FROM logs WHERE ts_sec >= {NOW - 15.5 * DAY_S}
""")
def a10_purge_batches(spark, sf_dir):
    """What stays of stored batches when days past their time are dropped."""
    base, rows = _base(spark), tables.log_rows(_logs(spark, sf_dir))
    for batch in range(2):
        tables.write_batch(rows.where(F.col("id") % 2 == batch), f"{base}/logs", batch)
    tables.purge_batches(spark, f"{base}/logs", float(NOW), days=15.5)
    return spark.read.parquet(f"{base}/logs").select("id", "ts_sec", "src_ip")


@query("r12_training_sample", ("logs",), f"""
SELECT id FROM logs WHERE {_LABEL} <> 'safe' OR (id * 7919) % 10000 < 500
""")
def r12_training_sample(spark, sf_dir):
    return maintain.training_sample(_logs(spark, sf_dir), "id", 0.05, pick="(id * 7919) % 10000").select("id")


@query("s5_read_packets", ("packets",), "SELECT packet_id, ts_us, src_ip, dst_port, protocol, bytes FROM packets")
def s5_read_packets(spark, sf_dir):
    """Packets written as JSON lines and read by the packet schema."""
    base = _base(spark)
    adapt(spark, sf_dir, "packets").write.json(f"{base}/packets")
    return tables.read_packets(spark, f"{base}/packets", fmt="json").select(
        "packet_id", "ts_us", "src_ip", "dst_port", "protocol", "bytes"
    )


@query("s1_read_csv_folder", (), """
SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_quantity AS DOUBLE) AS quantity,
  CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS mode FROM lineitem
""")
def s1_read_csv_folder(spark, sf_dir):
    """Files with headers of other order, blanks and one column less are one table."""
    base, rows = _base(spark), table(spark, sf_dir, "lineitem")
    even = rows.where("l_linenumber % 2 = 0").selectExpr("l_linestatus AS mode", "l_quantity AS ` quantity`", "l_orderkey AS key")
    odd = rows.where("l_linenumber % 2 = 1").selectExpr("l_orderkey AS `key `", "l_quantity AS quantity")
    even.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/even")
    odd.write.option("header", True).csv(f"{base}/odd")
    read = training.read_csv_folder(spark, [f"{base}/even", f"{base}/odd"])
    return read.select("key", F.col("quantity").cast("double").alias("quantity"), "mode")
