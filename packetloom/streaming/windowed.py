"""B12, A3 and the verdict sinks: micro-batches that run the batch operators.

A batch sees its own rows and the recent rows it can still depend on, kept as a Parquet
table between batches. Results equal those of the batch operators and large sources are
split the same way: a flooding source is no state of one task, as it would be under a state keyed by source. All writes of a batch go to places named by its number, so a batch
that runs again replaces its output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from packetloom.operators import alerts, behavior, dns, maintain
from packetloom.operators.behavior import SECOND_US
from packetloom.sources import tables


def _slot(path: str, batch_id: int) -> str:
    """Two slots take turns: a batch reads what the one before left, and can run again."""
    return f"{path}/slot={batch_id % 2}"


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left; None for the first. Later a missing slot is lost state."""
    if not batch_id:
        return None
    try:
        return spark.read.parquet(_slot(path, batch_id - 1))
    except AnalysisException as error:
        raise RuntimeError(f"the state that batch {batch_id - 1} left under {path} is missing") from error


@dataclass(frozen=True)
class EventTime:
    """How rows that arrive out of order are put in order.

    The watermark is ``delay_s`` before the newest time of the batches so far. A row waits in the state until the watermark has
    passed its time; then all rows before it are known and it is judged once, on its full window. Rows that
    come behind the watermark are written to ``late`` (one folder a batch) and take no part. ``jump_s`` bounds
    how far one batch may move the watermark, so that a row dated in the future does not make all others late.
    """

    delay_s: float
    state: str
    late: str
    jump_s: float | None = None
    at: str = "ts_us"

    def _clock(self, spark: SparkSession, batch_id: int) -> int | None:
        before = _before(spark, f"{self.state}/clock", batch_id)
        return None if before is None else before.head()["watermark"]

    def release(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, int | None]:
        """The rows that need not wait longer, and the time before which none is to come."""
        spark, at = batch.sparkSession, F.col(self.at)
        waiting, mark = _before(spark, f"{self.state}/waiting", batch_id), self._clock(spark, batch_id)
        behind = F.lit(False) if mark is None else at < mark
        batch.where(behind).write.mode("overwrite").parquet(f"{self.late}/batch={batch_id}")
        fresh = batch.where(~behind)
        whole = fresh if waiting is None else fresh.unionByName(waiting)
        newest = batch.agg(F.max(at)).head()[0]
        reached = None if newest is None else newest - int(self.delay_s * SECOND_US)
        if reached is not None and mark is not None and self.jump_s is not None:
            reached = min(reached, mark + int(self.jump_s * SECOND_US))
        mark = reached if mark is None else mark if reached is None else max(mark, reached)
        spark.createDataFrame([(mark, batch_id)], "watermark bigint, batch bigint").write.mode("overwrite").parquet(
            _slot(f"{self.state}/clock", batch_id)
        )
        ready = F.lit(False) if mark is None else at < mark
        whole.where(~ready).write.mode("overwrite").parquet(_slot(f"{self.state}/waiting", batch_id))
        return whole.where(ready), mark

    def late_rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All rows that came too late, with the number of the batch they came in."""
        return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(self.late)


Run = Callable[[DataFrame, int, int | None], None]


def _each(stream: DataFrame, run: Run, checkpoint: str, order: EventTime | None = None) -> DataStreamWriter:
    """Run a function on what each micro-batch releases; the batch is read from its source once."""
    def once(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            if order is None:
                run(held, batch_id, None)
            else:
                run(*_swap(order.release(held, batch_id), batch_id))
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)


def _swap(released: tuple[DataFrame, int | None], batch_id: int) -> tuple[DataFrame, int, int | None]:
    return released[0], batch_id, released[1]


def _finish(spark: SparkSession, run: Run, order: EventTime) -> None:
    """After the end of a stream: judge the rows that still wait, as a batch of their own."""
    last = spark.read.parquet(f"{order.state}/clock").agg(F.max("batch")).head()[0]
    run(_before(spark, f"{order.state}/waiting", last + 1), last + 1, None)


def _lookback_run(operator: Callable[[DataFrame], DataFrame], lookback_us: int, state: str, out: str, at: str) -> Run:
    def run(batch: DataFrame, batch_id: int, edge: int | None) -> None:
        fresh = batch.withColumn("_fresh", F.lit(True))
        before = _before(batch.sparkSession, state, batch_id)
        whole = fresh if before is None else fresh.unionByName(before.withColumn("_fresh", F.lit(False)))
        operator(whole).where("_fresh").drop("_fresh").write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )
        edge = whole.agg(F.max(at)).scalar() if edge is None else edge
        whole.drop("_fresh").where(F.col(at) >= edge - lookback_us).write.mode("overwrite").parquet(_slot(state, batch_id))

    return run


def with_lookback(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], lookback_us: int, state: str,
    out: str, checkpoint: str, at: str = "ts_us", order: EventTime | None = None,
) -> DataStreamWriter:
    """Run a batch operator over each micro-batch and the rows up to ``lookback_us`` before.

    Only rows of the batch are written. With ``order`` rows are judged in event time; without it, as they arrive, and
    rows of a batch that are older than the kept ones see what is left of their window.
    """
    return _each(stream, _lookback_run(operator, lookback_us, state, out, at), checkpoint, order)


def _detect(flood_s: float, scan_s: float, params: dict) -> tuple[Callable[[DataFrame], DataFrame], int]:
    return (
        lambda df: behavior.detect(df, flood_s=flood_s, scan_s=scan_s, **params),
        int(max(flood_s, scan_s) * SECOND_US),
    )


def _dns(window_s: float, params: dict) -> tuple[Callable[[DataFrame], DataFrame], int]:
    return lambda df: dns.dns_reasons(df, window_s=window_s, **params), int(window_s * SECOND_US)


def detect_stream(
    packets: DataFrame, state: str, out: str, checkpoint: str, flood_s: float = 3,
    scan_s: float = 8, order: EventTime | None = None, **params,
) -> DataStreamWriter:
    """Behavior.detect() on a packet stream."""
    return with_lookback(packets, *_detect(flood_s, scan_s, params), state, out, checkpoint, order=order)


def detect_rest(
    spark: SparkSession, state: str, out: str, order: EventTime, flood_s: float = 3, scan_s: float = 8, **params,
) -> None:
    """B12 after the end of a stream: the packets that wait for the watermark."""
    _finish_lookback(spark, *_detect(flood_s, scan_s, params), state, out, order)


def dns_stream(
    queries: DataFrame, state: str, out: str, checkpoint: str, window_s: float = 60,
    order: EventTime | None = None, **params,
) -> DataStreamWriter:
    """Dns.dns_reasons() on a stream of DNS queries."""
    return with_lookback(queries, *_dns(window_s, params), state, out, checkpoint, order=order)


def dns_rest(spark: SparkSession, state: str, out: str, order: EventTime, window_s: float = 60, **params) -> None:
    """B12 after the end of a stream: the DNS queries that wait for the watermark."""
    _finish_lookback(spark, *_dns(window_s, params), state, out, order)


def _finish_lookback(
    spark: SparkSession, operator: Callable[[DataFrame], DataFrame], lookback_us: int, state: str, out: str, order: EventTime
) -> None:
    _finish(spark, _lookback_run(operator, lookback_us, state, out, order.at), order)


def alert_stream(
    verdicts: DataFrame, state: str, out: str, checkpoint: str, n: int = 10,
    window_s: int = 1200, gap_s: int = 600, order: EventTime | None = None,
) -> DataStreamWriter:
    """A1-A4 on a verdict stream: one row per alert.

    Kept between batches: eligible rows of the last window and the last alert per source,
    which stands first among the candidates of its source and mutes those inside its gap.
    With ``order`` verdicts are taken in event time.
    """
    return _each(verdicts, _alert_run(state, out, n, window_s, gap_s), checkpoint, order)


def alert_rest(
    spark: SparkSession, state: str, out: str, order: EventTime, n: int = 10, window_s: int = 1200, gap_s: int = 600
) -> None:
    """A1-A4 after the end of a stream: the verdicts that wait for the watermark."""
    _finish(spark, _alert_run(state, out, n, window_s, gap_s), order)


def _alert_run(state: str, out: str, n: int, window_s: int, gap_s: int) -> Run:
    def run(batch: DataFrame, batch_id: int, edge: int | None) -> None:
        spark = batch.sparkSession
        fresh = alerts.eligible(batch).select("src_ip", "ts_us", "reasons").withColumn("_fresh", F.lit(True))
        before = _before(spark, f"{state}/events", batch_id)
        last = _before(spark, f"{state}/last", batch_id)
        whole = fresh if before is None else fresh.unionByName(before.withColumn("_fresh", F.lit(False)))
        counted = behavior.recent_counts(whole, window_s * SECOND_US, "burst_count")
        counts = counted.where(F.col("_fresh") & (F.col("burst_count") > n)).groupBy("src_ip", "ts_us").agg(
            F.max("burst_count").alias("burst_count")
        )
        candidates = counts.select("src_ip", "ts_us")
        if last is not None:
            ready = F.col("last_us").isNull() | (F.col("ts_us") - F.col("last_us") >= gap_s * SECOND_US)
            candidates = candidates.join(last, "src_ip", "left").where(ready).select("src_ip", "ts_us")
            candidates = candidates.unionByName(last.select("src_ip", F.col("last_us").alias("ts_us")))
        sent = alerts.debounce(candidates, gap_s)
        fired = alerts.alert_reasons(sent.join(counts, ["src_ip", "ts_us"]), whole, window_s)
        fired.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        edge = whole.agg(F.max("ts_us")).scalar() if edge is None else edge
        # An older alert mutes no row that the kept ones can still count.
        muting = F.col("last_us") > edge - (gap_s + window_s) * SECOND_US
        sent.groupBy("src_ip").agg(F.max("ts_us").alias("last_us")).where(muting).write.mode(
            "overwrite"
        ).parquet(_slot(f"{state}/last", batch_id))
        whole.drop("_fresh").where(F.col("ts_us") >= edge - window_s * SECOND_US).write.mode(
            "overwrite"
        ).parquet(_slot(f"{state}/events", batch_id))

    return run


def write_verdicts(
    verdicts: DataFrame, base: str, checkpoint: str, persist_safe: bool = False,
    safe_rate: float | None = 0.02,
) -> DataStreamWriter:
    """S8, S9, S10 and A9 from one verdict stream, under ``base``.

    Rows are stored by date and, within it, by batch. Verdicts without ``features`` fail
    unless ``safe_rate`` is None, which writes no training rows. dangerous_ips is merged with
    the state the batch before left.
    """
    def run(batch: DataFrame, batch_id: int, _: int | None) -> None:
        kept = maintain.keep_persistable(tables.log_rows(batch), persist_safe)
        tables.write_batch(kept, f"{base}/packet_logs", batch_id)
        tables.write_batch(tables.history_rows(batch), f"{base}/ai_history", batch_id)
        if safe_rate is not None:
            tables.training_rows(batch, safe_rate).write.mode("overwrite").parquet(
                f"{base}/training_data/batch={batch_id}"
            )
        found = maintain.dangerous_batch(batch)
        before = _before(batch.sparkSession, f"{base}/dangerous_ips", batch_id)
        if before is not None:
            found = maintain.upsert_dangerous(before.drop("batch"), found)
        found.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            _slot(f"{base}/dangerous_ips", batch_id)
        )

    return _each(verdicts, run, checkpoint)


def dangerous_ips(spark: SparkSession, base: str) -> DataFrame:
    """The table write_verdicts() left after its last batch."""
    slots = spark.read.parquet(f"{base}/dangerous_ips")
    newest = slots.agg(F.max("batch")).scalar()
    return slots.where(F.col("batch") == newest).drop("batch", "slot")
