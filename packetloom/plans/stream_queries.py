"""Registered queries: the same rules over streams, read to their end."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans.adapters import adapt
from packetloom.plans.log_queries import _ELIGIBLE, _LABEL, _RAW_TREND, _REC, _counts
from packetloom.plans.packet_queries import DAY_S, DAY_US, _precedence
from packetloom.plans.registry import SQL, query
from packetloom.session import shared_dir
from packetloom.sources import lists
from packetloom.streaming import streams, windowed


def _run(spark: SparkSession, sf_dir: str, name: str, start, pieces: int = 3, delay_us: int = 0) -> str:
    """Feed an adapter to a file stream, one range of arrival times after the other.

    ``start(stream, base)`` gives the writer. Every range is one run of the stream over
    the files that are new. Rows arrive up to ``delay_us`` after their time, as their ids say, so not in time
    order. Returns the work folder.
    """
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = adapt(spark, sf_dir, name)
    # A stream keeps one state store per shuffle partition: as many as there are cores.
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        _feed(spark, rows, base, start, pieces, delay_us)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return base


def _feed(spark: SparkSession, rows: DataFrame, base: str, start, pieces: int, delay_us: int) -> None:
    arrival = F.col("ts_us") + F.col(rows.columns[0]) * 7919 % 1000 * (delay_us // 1000)
    low, high = rows.agg(F.min(arrival), F.max(arrival)).head()
    step = (high - low) // pieces + 1
    for piece in range(pieces):
        rows.where(F.floor((arrival - low) / step) == piece).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        start(stream, base).trigger(availableNow=True).start().awaitTermination()


def _order(base: str, delay_s: float) -> windowed.EventTime:
    return windowed.EventTime(delay_s, f"{base}/order", f"{base}/late")


def _to_files(df: DataFrame, base: str):
    return (
        df.writeStream.outputMode("append").format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    )


@query("q5_minute_counts_stream", ("logs",), f"""
, l AS (SELECT CAST(floor(ts_sec / 60) * 60 AS BIGINT) AS bucket, {_LABEL} AS label, CAST(round(({_RAW_TREND}) * 1000000) AS BIGINT) AS score FROM logs)
SELECT bucket, {_counts()}, count(*) AS total, CAST(sum(score) AS DOUBLE) / 1000000 / count(*) AS avg_risk FROM l
GROUP BY bucket HAVING bucket + 60 <= (SELECT max(ts_us) FROM logs) / 1e6 - 60
""")
def q5_minute_counts_stream(spark, sf_dir):
    """Minutes the watermark has closed; the last ones stay open in a stream."""
    base = _run(
        spark, sf_dir, "logs", lambda df, base: _to_files(streams.minute_counts(df, "1 minute"), base)
    )
    return spark.read.parquet(f"{base}/out")


_WINDOWS = {"flood_n": 5, "flood_s": 2 * DAY_S, "scan_n": 4, "scan_s": 3 * DAY_S}


def _detected(spark, sf_dir, arrive_us: int) -> tuple[str, windowed.EventTime]:
    """Packets that arrive up to ``arrive_us`` late, judged behind a watermark of a day."""
    base = _run(
        spark, sf_dir, "packets",
        lambda df, base: windowed.detect_stream(
            df, f"{base}/state", f"{base}/out", f"{base}/checkpoint", order=_order(base, DAY_S), **_WINDOWS
        ),
        delay_us=arrive_us,
    )
    windowed.detect_rest(spark, f"{base}/state", f"{base}/out", _order(base, DAY_S), **_WINDOWS)
    return base, _order(base, DAY_S)


@query("b12_detect_stream", ("packets",), _precedence(5, 2 * DAY_US, 4, 3 * DAY_US))
def b12_detect_stream(spark, sf_dir):
    """Packets out of order within the watermark get the labels of the batch operator."""
    base, _ = _detected(spark, sf_dir, DAY_US)
    return spark.read.parquet(f"{base}/out").select("packet_id", "src_ip", "behavior")


@query("b12_late_packets_stream", ("packets",), f"""
, a AS (SELECT packet_id, src_ip, ts_us, ts_us + packet_id * 7919 % 1000 * {5 * DAY_US // 1000} AS arrival FROM packets),
r AS (SELECT min(arrival) AS low, (max(arrival) - min(arrival)) // 3 + 1 AS step FROM a),
p AS (SELECT a.*, (arrival - low) // step AS piece FROM a, r),
m AS (SELECT x.piece, max(y.ts_us) - {DAY_US} AS mark FROM (SELECT DISTINCT piece FROM p) x JOIN p y ON y.piece < x.piece GROUP BY x.piece)
SELECT packet_id, src_ip, ts_us FROM p JOIN m ON m.piece = p.piece WHERE ts_us < mark
""")
def b12_late_packets_stream(spark, sf_dir):
    """Packets that arrive up to five days late: those behind the watermark are kept apart."""
    base, order = _detected(spark, sf_dir, 5 * DAY_US)
    packets = adapt(spark, sf_dir, "packets")
    return order.late_rows(spark, packets.schema).select("packet_id", "src_ip", "ts_us")


@query("b12_dns_stream", ("dns",), SQL["b11_dns_reasons"].partition("FROM events)")[2])
def b12_dns_stream(spark, sf_dir):
    """DNS queries out of order within the watermark get the reasons of the batch operator."""
    rules = {"window_s": DAY_S, "long": 24, "entropy": 3.6, "unique": 12, "txt": 4, "churn": 10}
    base = _run(
        spark, sf_dir, "dns",
        lambda df, base: windowed.dns_stream(
            df, f"{base}/state", f"{base}/out", f"{base}/checkpoint", order=_order(base, DAY_S), **rules
        ),
        delay_us=DAY_US,
    )
    windowed.dns_rest(spark, f"{base}/state", f"{base}/out", _order(base, DAY_S), **rules)
    return spark.read.parquet(f"{base}/out").select(
        "dns_id", F.array_join("dns_reasons", ",").alias("dns_reasons")
    )


@query("a3_alert_stream", ("logs",), _ELIGIBLE + _REC + """
SELECT f.src_ip, f.ts_us, cand.burst_count FROM fired f JOIN cand ON cand.src_ip = f.src_ip AND cand.ts_us = f.ts_us
WHERE f.ts_us IS NOT NULL
""")
def a3_alert_stream(spark, sf_dir):
    rules = {"n": 1, "window_s": 3 * DAY_S, "gap_s": 2 * DAY_S}
    base = _run(
        spark, sf_dir, "logs",
        lambda df, base: windowed.alert_stream(
            df, f"{base}/state", f"{base}/out", f"{base}/checkpoint", order=_order(base, DAY_S), **rules
        ),
        delay_us=DAY_US,
    )
    windowed.alert_rest(spark, f"{base}/state", f"{base}/out", _order(base, DAY_S), **rules)
    return spark.read.parquet(f"{base}/out").select("src_ip", "ts_us", "burst_count")


def _append_log(lines: DataFrame, path: str, head: str = "", end: str = "\n") -> None:
    """Lines, as Spark writes them, behind what a log holds; ``head`` begins the log anew."""
    parts = f"{shared_dir(lines.sparkSession)}/{uuid.uuid4().hex}"
    lines.write.text(parts, lineSep="\n")
    store, where = fs.FileSystem.from_uri(parts) if "://" in parts or parts.startswith("file:") else (fs.LocalFileSystem(), parts)
    log = fs.FileSystem.from_uri(path)[1] if "://" in path or path.startswith("file:") else path
    written = store.get_file_info(fs.FileSelector(where))
    if head:
        store.create_dir(log.rpartition("/")[0])
    with (store.open_output_stream if head else store.open_append_stream)(log) as out:
        out.write(head.encode())
        for part in sorted(p.path for p in written if p.base_name.startswith("part-")):
            with store.open_input_stream(part) as held:
                while block := held.read(1 << 20):
                    out.write(block)
        out.write(end.encode())


@query("s7_zeek_tail_stream", ("zeek_conn",), """
SELECT CAST(uid AS VARCHAR) AS uid, orig_h, resp_h, resp_p, conn_state, proto, resp_bytes, duration FROM zeek_conn
""")
def s7_zeek_tail_stream(spark, sf_dir):
    """Two logs that grow between runs of a stream; then one is rewritten with other columns."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    names = ["uid", "orig_h", "resp_h", "resp_p", "conn_state", "proto", "resp_bytes", "duration"]
    other = ["note", *reversed(names)]
    rows = adapt(spark, sf_dir, "zeek_conn").withColumn("note", F.lit("-"))

    def head(columns: list[str]) -> str:
        shown = {"orig_h": "id.orig_h", "resp_h": "id.resp_h", "resp_p": "id.resp_p"}
        return "#separator \\x09\n#fields\t" + "\t".join(shown.get(c, c) for c in columns) + "\n"

    def lines(log: int, step: int, columns: list[str]) -> DataFrame:
        mine = rows.where((F.col("uid") % 2 == log) & (F.col("uid") % 3 == step))
        return mine.select(F.concat_ws("\t", *columns).alias("value"))

    def run() -> None:
        logs = lists.read_zeek(spark, f"{base}/logs", streaming=True, fields=["uid", "id.orig_h", "id.resp_h", "id.resp_p", *names[4:]])
        _to_files(logs, base).trigger(availableNow=True).start().awaitTermination()

    for step in range(3):
        for log, columns in enumerate((names, other if step == 2 else names)):
            # The last line of a piece is not whole until the next piece, or a blank line, follows.
            anew = head(columns) if not step or (log and step == 2) else ""
            _append_log(lines(log, step, columns), f"{base}/logs/{log}.log", anew, "" if step < 2 else "\n#close\n")
        run()
    return spark.read.parquet(f"{base}/out").select(*names)


@query("s8_write_verdicts", ("logs",), """
SELECT 'packet_logs' AS sink, count(*) FILTER (WHERE classification <> 'safe') AS n, CAST(sum(id) FILTER (WHERE classification <> 'safe') AS BIGINT) AS ids FROM logs
UNION ALL SELECT 'ai_history', count(*), CAST(sum(id) AS BIGINT) FROM logs
UNION ALL SELECT 'training_data', count(*), CAST(sum(id) AS BIGINT) FROM logs
UNION ALL SELECT 'dangerous_ips', count(DISTINCT src_ip), count(*) FROM logs WHERE classification = 'dangerous'
""")
def s8_write_verdicts(spark, sf_dir):
    base = _run(
        spark, sf_dir, "logs",
        lambda df, base: windowed.write_verdicts(
            df.withColumn("features", F.array(F.col("id").cast("double"), "confidence")),
            f"{base}/store", f"{base}/checkpoint", safe_rate=1.0,
        ),
    )

    def counted(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/store/{name}").agg(
            F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum("id").alias("ids")
        )

    bad = windowed.dangerous_ips(spark, f"{base}/store")
    first = F.from_json("features_json", "array<double>")[0]
    taught = spark.read.parquet(f"{base}/store/training_data").agg(
        F.lit("training_data").alias("sink"), F.count("*").alias("n"), F.sum(first).cast("bigint").alias("ids")
    )
    return counted("packet_logs").unionByName(counted("ai_history")).unionByName(taught).unionByName(
        bad.agg(F.lit("dangerous_ips").alias("sink"), F.count("*").alias("n"), F.sum("event_count").alias("ids"))
    )


@query("f2_closed_flows_stream", ("packets",), """
, o AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM packets),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT src_ip, dst_ip, protocol, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE contains(tcp_flags, 'S')) AS syn, count(*) FILTER (WHERE contains(tcp_flags, 'A')) AS ack
FROM s GROUP BY src_ip, dst_ip, protocol, sid HAVING max(ts_us) + 43200000000 <= (SELECT max(ts_us) FROM packets) - 60000000
""")
def f2_closed_flows_stream(spark, sf_dir):
    """Flows the watermark has closed."""
    def start(df, base):
        one_port = df.withColumns({"src_port": F.lit(1), "dst_port": F.lit(2)})
        return _to_files(streams.closed_flows(one_port, "12 hours"), base)

    base = _run(spark, sf_dir, "packets", start)
    return spark.read.parquet(f"{base}/out").select(
        "src_ip", "dst_ip", "protocol", "start_us", "end_us", "packets", "bytes", "syn", "ack"
    )
