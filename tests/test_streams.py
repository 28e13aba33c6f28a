"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_windows import dns_rows, traffic

from packetloom.operators import behavior, dns
from packetloom.sources import tables
from packetloom.streaming import streams, windowed


def feed(spark, df, path, start, pieces=3):
    n = df.count()
    for k in range(pieces):
        df.where(F.col(df.columns[0]) * pieces >= k * n).where(F.col(df.columns[0]) * pieces < (k + 1) * n).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        start(stream).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_detect(spark, tmp_path):
    df = spark.createDataFrame(traffic(3, 1600), "packet_id long, ts_us long, src_ip string, dst_port int")
    path = str(tmp_path)
    out = feed(spark, df, path, lambda s: windowed.detect_stream(s, f"{path}/state", f"{path}/out", f"{path}/cp"))
    # A scan may look back over more than the kept seconds only through row counts, so
    # rows are compared with the batch result.
    want = {r.packet_id: r.behavior for r in behavior.detect(df).collect()}
    assert {r.packet_id: r.behavior for r in out.collect()} == want


def test_missing_state_fails(spark, tmp_path):
    with pytest.raises(RuntimeError, match="missing"):
        windowed._before(spark, str(tmp_path / "state"), 3)
    assert windowed._before(spark, str(tmp_path / "state"), 0) is None


def test_dns(spark, tmp_path):
    df = spark.createDataFrame(dns_rows(9, 700), "dns_id long, ts_us long, src_ip string, qname string, qtype string")
    path = str(tmp_path)
    out = feed(spark, df, path, lambda s: windowed.dns_stream(s, f"{path}/state", f"{path}/out", f"{path}/cp"))
    want = {r.dns_id: r.dns_reasons for r in dns.dns_reasons(df).collect()}
    assert {r.dns_id: r.dns_reasons for r in out.collect()} == want


def test_duplicates_and_sliding_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, 10**15, "a", 5), (1, 10**15, "a", 5), (2, 10**15 + 1, "a", 6), (9, 10**15 + 60_000_000, "b", 1)],
                               "packet_id long, ts_us long, src_ip string, dst_port int")
    path = str(tmp_path)
    df.write.parquet(f"{path}/in")
    stream = tables.read_packets(spark, f"{path}/in", streaming=True, schema=df.schema, files_per_trigger=10)
    unique = streams.deduplicated(stream, "1 minute").drop("event_time")
    unique.writeStream.format("parquet").option("path", f"{path}/unique").option("checkpointLocation", f"{path}/cp1").trigger(
        availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{path}/unique").count() == 3
    slides = streams.sliding_behavior(tables.read_packets(spark, f"{path}/unique", schema=df.schema))
    assert slides.where("src_ip = 'a' AND packets = 2 AND ports = 2").count() == 8


def shuffled(df, late_us):
    """Rows with arrival ranks: each comes up to ``late_us`` after its time."""
    arrival = F.col("ts_us") + F.col(df.columns[0]) * 7919 % 1000 * (late_us // 1000)
    order = Window.orderBy(arrival, df.columns[0])
    return df.withColumn("rank", F.row_number().over(order) - 1).select("rank", *df.columns)


def test_out_of_order_packets(spark, tmp_path):
    """Batch results whatever the order of arrival, while delays stay within the watermark."""
    df = spark.createDataFrame(traffic(5, 1500), "packet_id long, ts_us long, src_ip string, dst_port int")
    path = str(tmp_path)
    order = windowed.EventTime(4, f"{path}/order", f"{path}/late")
    out = feed(
        spark, shuffled(df, 4_000_000), path,
        lambda s: windowed.detect_stream(s, f"{path}/state", f"{path}/out", f"{path}/cp", order=order), 4,
    )
    assert out.count() < df.count()
    windowed.detect_rest(spark, f"{path}/state", f"{path}/out", order)
    windowed.detect_rest(spark, f"{path}/state", f"{path}/out", order)  # again: the same place
    got = spark.read.parquet(f"{path}/out").collect()
    want = {r.packet_id: r.behavior for r in behavior.detect(df).collect()}
    assert len(got) == len(want) and {r.packet_id: r.behavior for r in got} == want
    assert order.late_rows(spark, df.schema).count() == 0


def test_late_packets_stand_apart(spark, tmp_path):
    """Late rows are kept apart with their batch; the others are judged as if these had not come."""
    df = spark.createDataFrame(traffic(6, 1500), "packet_id long, ts_us long, src_ip string, dst_port int")
    path = str(tmp_path)
    order = windowed.EventTime(1, f"{path}/order", f"{path}/late")
    rows = shuffled(df, 30_000_000).cache()
    feed(spark, rows, path, lambda s: windowed.detect_stream(s, f"{path}/state", f"{path}/out", f"{path}/cp", order=order), 4)
    windowed.detect_rest(spark, f"{path}/state", f"{path}/out", order)
    late, mark, n = set(), None, df.count()
    ranked = sorted(rows.collect())
    for k in range(4):
        piece = [r for r in ranked if k * n <= r.rank * 4 < (k + 1) * n]
        late |= {(r.packet_id, k) for r in piece if mark is not None and r.ts_us < mark}
        mark = max([r.ts_us for r in piece]) - 1_000_000 if mark is None else max(mark, max(r.ts_us for r in piece) - 1_000_000)
    assert late and {(r.packet_id, r.batch) for r in order.late_rows(spark, rows.schema).collect()} == late
    kept = df.join(spark.createDataFrame(sorted(late), "packet_id long, batch long"), "packet_id", "left_anti")
    want = {r.packet_id: r.behavior for r in behavior.detect(kept).collect()}
    assert {r.packet_id: r.behavior for r in spark.read.parquet(f"{path}/out").collect()} == want


def test_a_date_in_the_future_moves_the_watermark_little(spark, tmp_path):
    order = windowed.EventTime(1, f"{tmp_path}/order", f"{tmp_path}/late", jump_s=10)
    marks = []
    for k, times in enumerate(([5_000_000], [6_000_000, 10**15], [9_000_000, 20_000_000])):
        batch = spark.createDataFrame([(t,) for t in times], "ts_us long")
        ready, mark = order.release(batch, k)
        marks.append((mark, sorted(r.ts_us for r in ready.collect())))
    assert marks == [(4_000_000, []), (14_000_000, [5_000_000, 6_000_000]), (19_000_000, [])]
    assert [(r.ts_us, r.batch) for r in order.late_rows(spark, batch.schema).collect()] == [(9_000_000, 2)]
