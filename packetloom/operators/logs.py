"""Q1-Q24: queries over stored verdicts.

A log table has id, ts_sec (epoch seconds), src_ip, dst_ip, src_port, dst_port, protocol,
url, classification, ai_label, ai_score, risk_score, anomaly_score, confidence and
reasons. A stored table is partitioned by event_date; time filters then prune it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import risk, text
from packetloom.functions.times import RANGES_S, bucket_start

_CLASSES = ("safe", "suspicious", "dangerous")
_MICRO = 1_000_000


def between(
    df: DataFrame, start: float | None = None, end: float | None = None,
    before: float | None = None, ts: str = "ts_sec",
) -> DataFrame:
    """Rows with start <= ts <= end and ts < before; prunes event_date partitions."""
    tests: list[Column] = []
    has_date = "event_date" in df.columns

    def day(seconds: float) -> Column:
        return F.timestamp_seconds(F.lit(float(seconds))).cast("date")

    if start is not None:
        tests.append(F.col(ts) >= float(start))
        tests += [F.col("event_date") >= day(start)] if has_date else []
    for limit, test in ((end, Column.__le__), (before, Column.__lt__)):
        if limit is not None:
            tests.append(test(F.col(ts), F.lit(float(limit))))
            tests += [F.col("event_date") <= day(limit)] if has_date else []
    return df.where(reduce(Column.__and__, tests)) if tests else df


def search(
    df: DataFrame, *, ip: str | None = None, src_ip: str | None = None,
    dst_ip: str | None = None, port: int | None = None, src_port: int | None = None,
    dst_port: int | None = None, protocol: str | None = None, url: str | None = None,
    classification: str | None = None, ai_label: str | None = None,
    reason: str | None = None, has_threat_intel: bool | str | None = None,
    start_time: float | None = None, end_time: float | None = None,
    before_time: float | None = None, min_ai_score: float | None = None,
    max_ai_score: float | None = None, min_anomaly_score: float | None = None,
    max_anomaly_score: float | None = None, min_confidence: float | None = None,
    max_confidence: float | None = None, case_sensitive: bool = False,
    intel: tuple[str, ...] = ("ti_ip", "ti_url"),
) -> DataFrame:
    """Q1, Q23: rows that pass all given filters; empty filters are ignored.

    Substrings are literal. A least model score of 0 keeps rows without a score.
    """
    tests: list[Column] = []

    def has(column: Column, part: str) -> Column:
        return column.contains(part) if case_sensitive else F.lower(column).contains(part.lower())

    if ip:
        tests.append((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    if port is not None:
        tests.append((F.col("src_port") == int(port)) | (F.col("dst_port") == int(port)))
    for name, value in (
        ("src_ip", src_ip), ("dst_ip", dst_ip), ("classification", classification),
        ("ai_label", ai_label),
    ):
        if value:
            tests.append(F.col(name) == value)
    for name, number in (("src_port", src_port), ("dst_port", dst_port)):
        if number is not None:
            tests.append(F.col(name) == int(number))
    if protocol:
        tests.append(F.upper("protocol") == protocol.strip().upper())
    if url:
        tests.append(has(F.col("url"), url))
    if reason:
        tests.append(F.exists("reasons", lambda r: has(r, reason)))
    if has_threat_intel not in (None, ""):
        wanted = str(has_threat_intel).lower() in ("1", "true", "yes")
        present = reduce(Column.__or__, [F.col(c).isNotNull() for c in intel if c in df.columns])
        tests.append(present if wanted else ~present)
    if min_ai_score is not None and min_ai_score > 0:
        tests.append(F.col("ai_score") >= float(min_ai_score))
    if max_ai_score is not None:
        tests.append(F.col("ai_score") <= float(max_ai_score))
    for name, low, high in (
        ("anomaly_score", min_anomaly_score, max_anomaly_score),
        ("confidence", min_confidence, max_confidence),
    ):
        if low is not None:
            tests.append(F.col(name) >= float(low))
        if high is not None:
            tests.append(F.col(name) <= float(high))
    found = between(df, start_time, end_time, before_time)
    return found.where(reduce(Column.__and__, tests)) if tests else found


def newest(
    df: DataFrame, limit: int = 200, ts: str = "ts_sec", cap: int | None = None
) -> DataFrame:
    """Newest rows first; ``cap`` may bound what callers ask for."""
    wanted = max(1, int(limit))
    return df.orderBy(F.desc(ts), F.desc("id")).limit(wanted if cap is None else min(wanted, cap))


def page(
    df: DataFrame, limit: int = 200, after: tuple[float, int] | None = None, ts: str = "ts_sec"
) -> DataFrame:
    """Q3: the page that follows the row ``after`` = (time, id) in newest-first order.

    The pair keeps rows that share a time with the page edge. For a cursor of the time
    alone use search(before_time=...) and newest().
    """
    if after is not None:
        time, last_id = float(after[0]), int(after[1])
        earlier = (F.col(ts) < time) | ((F.col(ts) == time) & (F.col("id") < last_id))
        df = between(df, end=time, ts=ts).where(earlier)
    return newest(df, limit, ts)


def next_cursor(rows: DataFrame, ts: str = "ts_sec") -> DataFrame:
    """Q3: the cursor after a page, as one row (NULLs for an empty page)."""
    edge = F.struct(F.col(ts), F.col("id"))
    return rows.agg(F.min(edge).alias("_edge")).select(
        F.col(f"_edge.{ts}").alias("next_time"), F.col("_edge.id").alias("next_id")
    )


def _class_counts(label: Column) -> list[Column]:
    return [F.count_if(label == c).alias(c) for c in _CLASSES]


def window_totals(
    df: DataFrame, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Q4: counts per class and the number of distinct attackers, as one row."""
    label = risk.known_class(F.col("classification"))
    attacker = F.when((label == "dangerous") & (F.col("src_ip") != ""), F.col("src_ip"))
    return between(df, start, end).agg(
        F.count("*").alias("total"), *_class_counts(label),
        F.count_distinct(attacker).alias("unique_attackers"),
    )


def dangerous_sources(
    df: DataFrame, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Q4: the sources of dangerous rows, one row each, sorted."""
    bad = (risk.known_class(F.col("classification")) == "dangerous") & (F.col("src_ip") != "")
    return between(df, start, end).where(bad).select("src_ip").distinct().orderBy("src_ip")


def _series(rows: DataFrame, label: Column, score: Column, seeds: DataFrame | None) -> DataFrame:
    """Counts per bucket and class and the sum of scores, with empty seeded buckets.

    Scores are added in whole millionths: the sum does not depend on row order.
    """
    counted = rows.groupBy("bucket").agg(
        F.count("*").alias("total"), *_class_counts(label),
        F.sum(F.round(score * _MICRO).cast("long")).alias("_sum"),
    )
    if seeds is None:
        return counted
    zero = F.lit(0).cast("long")
    empty = seeds.select("bucket", *[zero.alias(c) for c in ("total", *_CLASSES, "_sum")])
    return counted.unionByName(empty).groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in ("total", *_CLASSES, "_sum")]
    )


def _with_mean(series: DataFrame, digits: int | None) -> DataFrame:
    mean = F.when(F.col("total") > 0, F.col("_sum") / _MICRO / F.col("total")).otherwise(0.0)
    if digits is not None:
        mean = F.bround(mean, digits)
    return series.select("bucket", *_CLASSES, "total", mean.alias("avg_risk"))


def minute_buckets(
    df: DataFrame, start: float, end: float, minutes: int | None = None
) -> DataFrame:
    """Q6: the minutes from start to end, or the first ``minutes`` of them."""
    first, past = int(start // 60) * 60, int(end // 60) * 60 + 60
    if minutes is not None:
        past = min(past, first + 60 * max(1, int(minutes)))
    return df.sparkSession.range(first, max(first, past), 60).select(F.col("id").alias("bucket"))


def timeseries(
    history: DataFrame, start: float, end: float, minutes: int | None = None,
    logs: DataFrame | None = None, ts: str = "ts_sec", digits: int | None = 4,
) -> DataFrame:
    """Q5-Q7: counts per minute and class with the mean score, gaps filled with zeros.

    ``logs`` is used when ``history`` has no row in the range; whether any source had
    rows is the column ``has_data``.
    """
    rows = between(history, start, end, ts=ts)
    if logs is not None and rows.isEmpty():
        rows = between(logs, start, end, ts=ts)
    stored = F.col("classification")
    score = risk.trend_score(F.col("ai_score"), F.col("risk_score"), stored)
    rows = rows.select(
        bucket_start(F.col(ts)).alias("bucket"), risk.known_class(stored).alias("_label"),
        score.alias("_score"),
    )
    series = _series(
        rows, F.col("_label"), F.col("_score"), minute_buckets(history, start, end, minutes)
    )
    with_mean = _with_mean(series, digits)
    any_row = with_mean.agg(F.sum("total") > 0).scalar()
    return with_mean.withColumn("has_data", any_row)


def series_totals(series: DataFrame) -> DataFrame:
    """Q8: sums over a series, as one row."""
    return series.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_CLASSES, "total")])


def _shown(df: DataFrame) -> tuple[Column, Column]:
    """Q9, Q10: class and score of a row as charts show them."""
    label = risk.effective_class(F.col("classification"), F.col("risk_score"), F.col("ai_score"))
    return label, risk.trend_score(F.col("ai_score"), F.col("risk_score"), label)


def with_shown(df: DataFrame) -> DataFrame:
    """Q9, Q10 as columns."""
    label, score = _shown(df)
    return df.withColumns({"effective_class": label, "trend_score": score})


def _top(scored: DataFrame, key: str, n: int, fallback: DataFrame | None) -> DataFrame:
    top = scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("score").alias("score"))
    if fallback is not None:
        spare = fallback.select(key).distinct().withColumn("score", F.lit(1.0))
        used = scored.where(F.col(key).isNotNull()).select(F.lit(1)).limit(1)
        top = top.unionByName(spare.where(~used.exists()))
    return top.orderBy(F.desc("score"), key).limit(n)


def top_ips(
    df: DataFrame, n: int = 10, row_limit: int | None = None, fallback: DataFrame | None = None
) -> DataFrame:
    """Q11: addresses with the highest score; ``fallback`` has src_ip.

    All rows count; ``row_limit`` takes only the newest ones.
    """
    rows = newest(df, row_limit) if row_limit else df
    key = F.coalesce(F.nullif("src_ip", F.lit("")), F.nullif("dst_ip", F.lit("")))
    scored = rows.select(key.alias("src_ip"), _shown(rows)[1].alias("score"))
    return _top(scored, "src_ip", n, fallback)


def _host(df: DataFrame) -> Column:
    return text.event_host(F.col("url"), F.col("http.host") if "http" in df.columns else None)


def top_domains(
    df: DataFrame, n: int = 10, row_limit: int | None = None, dangerous_urls: DataFrame | None = None
) -> DataFrame:
    """Q12: hosts with the highest score, else those of ``dangerous_urls`` (url)."""
    rows = newest(df, row_limit) if row_limit else df
    scored = rows.select(_host(rows).alias("host"), _shown(rows)[1].alias("score"))
    spare = None
    if dangerous_urls is not None:
        bare = F.split(F.split("url", "/").getItem(0), ":").getItem(0)
        host = F.coalesce(text.event_host(F.col("url")), F.nullif(bare, F.lit("")))
        spare = dangerous_urls.select(host.alias("host")).where(F.col("host").isNotNull())
    return _top(scored, "host", n, spare)


def dns_like(reasons: Column) -> Column:
    """Q14: some reason speaks of DNS or a tunnel."""
    return F.coalesce(
        F.exists(reasons, lambda r: F.lower(r).startswith("dns_") | F.lower(r).contains("tunnel")),
        F.lit(False),
    )


def dns_timeline(df: DataFrame, end: float | None = None, ts: str = "ts_sec") -> DataFrame:
    """Q14: suspect DNS rows per minute; rows without a time count in the last minute."""
    bucket = bucket_start(F.col(ts))
    if end is not None:
        bucket = F.coalesce(bucket, F.lit(int(end // 60) * 60).cast("long"))
    return (
        df.where(dns_like(F.col("reasons")))
        .groupBy(bucket.alias("bucket")).agg(F.count("*").alias("suspect_dns"))
    )


def severity_series(
    df: DataFrame, now: float, minutes: int = 60, totals: DataFrame | None = None,
    ts: str = "ts_sec", digits: int | None = None,
) -> DataFrame:
    """Q15: counts and mean score per minute of the last ``minutes``.

    Rows outside the range count in the first or last bucket. With ``totals`` (one row of
    window_totals) an empty series is filled evenly (Q16).
    """
    start = int(now) - minutes * 60
    first, last = start // 60 * 60, int(now) // 60 * 60
    place = F.least(F.greatest(bucket_start(F.col(ts)), F.lit(first)), F.lit(last))
    label, score = _shown(df)
    rows = df.select(
        F.coalesce(place, F.lit(first)).cast("long").alias("bucket"),
        label.alias("_label"), score.alias("_score"),
    )
    seeds = df.sparkSession.range(minutes).select((F.col("id") * 60 + first).alias("bucket"))
    series = _with_mean(_series(rows, F.col("_label"), F.col("_score"), seeds), digits)
    return spread_totals(series, totals, minutes) if totals is not None else series


def spread_totals(series: DataFrame, totals: DataFrame, minutes: int) -> DataFrame:
    """Q16: give every bucket an equal share of the totals when the series is empty."""
    empty = series.agg(F.sum("total") == 0).scalar() & totals.select(F.col("total") > 0).scalar()
    shares = {c: totals.select(F.greatest(F.col(c), F.lit(0)) / minutes).scalar() for c in _CLASSES}
    spread = series.withColumns(
        {c: F.when(empty, share).otherwise(F.col(c).cast("double")) for c, share in shares.items()}
    )
    return spread.withColumn("total", sum((F.col(c) for c in _CLASSES[1:]), F.col(_CLASSES[0])))


def distribution(*sources: DataFrame) -> DataFrame:
    """Q17: class counts of the first source that has any, else zeros.

    Every source is one row with the class columns, most trusted first.
    """
    def ranked(df: DataFrame, rank: int) -> DataFrame:
        return df.select(*[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in _CLASSES],
                         F.lit(rank).alias("_rank"))

    spark = sources[0].sparkSession
    rows = [ranked(df, i) for i, df in enumerate(sources)]
    filled = reduce(DataFrame.unionByName, rows).where(sum((F.col(c) for c in _CLASSES), F.lit(0)) > 0)
    zero = spark.range(1).select(*[F.lit(0).alias(c) for c in _CLASSES])
    return filled.unionByName(ranked(zero, len(rows))).orderBy("_rank").limit(1).drop("_rank")


def risk_trend(series: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Q18: mean score per bucket; a constant inferred from ``totals`` if it is all zero."""
    trend = series.select("bucket", "avg_risk")
    if totals is None:
        return trend
    flat = ~series.agg(F.coalesce(F.max("avg_risk") > 0, F.lit(False))).scalar()
    guess = totals.select(
        F.when(
            F.col("total") > 0,
            F.least(
                F.lit(1.0),
                0.2 + F.col("dangerous") / F.col("total") * 0.75
                + F.col("suspicious") / F.col("total") * 0.35,
            ),
        )
    ).scalar()
    return trend.withColumn(
        "avg_risk", F.when(flat, F.coalesce(guess, F.lit(0.0))).otherwise(F.col("avg_risk"))
    )


def sort_by(df: DataFrame, col: str, descending: bool = True) -> DataFrame:
    """Q19: by any column; text is compared without case."""
    key = F.lower(col) if dict(df.dtypes)[col] == "string" else F.col(col)
    return df.orderBy(key.desc() if descending else key.asc())


def free_text(df: DataFrame, q: str) -> DataFrame:
    """Q20: rows whose JSON form contains the text, without case."""
    if not q.strip():
        return df
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.where(F.lower(whole).contains(q.strip().lower()))


def last(df: DataFrame, span: str, as_of: float, ts: str = "ts_sec") -> DataFrame:
    """Q21: rows of a named range (15m, 1h, 6h, 24h, 7d) up to ``as_of``."""
    return between(df, as_of - RANGES_S[span], as_of, ts=ts)


def matching(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    """Q24: rows where one of the columns contains the text, without case."""
    q = q.strip().lower()
    if not q:
        return df
    return df.where(reduce(Column.__or__, [F.lower(F.col(c)).contains(q) for c in cols]))


def offset_page(
    df: DataFrame, q: str = "", cols: list[str] | None = None, sort: str = "id",
    order: str = "desc", page: int = 1, page_size: int = 25, sortable: list[str] | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Q24: one numbered page; matching(...).count() is the total.

    An unknown sort column or order falls back to the default; ``largest`` may bound the size.
    """
    sort = sort if sort in (sortable or df.columns) else "id"
    size = max(1, int(page_size))
    size = size if largest is None else min(size, largest)
    found = matching(df, q, cols or [])
    key = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    keys = [key] if sort == "id" else [key, F.col("id").desc()]
    return found.orderBy(*keys).offset((max(1, int(page)) - 1) * size).limit(size)


def log_view(df: DataFrame) -> DataFrame:
    """E5: stored row as served; JSON text columns are decoded."""
    out = df
    if "reasons_json" in df.columns:
        out = out.withColumn("reasons", text.decode_reasons(F.col("reasons_json")))
    for name in ("http", "ti_ip", "ti_url", "dns"):
        if f"{name}_json" in df.columns:
            out = out.withColumn(name, text.decode_object(F.col(f"{name}_json")))
    hidden = ("reasons_json", "ti_ip_json", "ti_url_json", "dns_json", "ai_explanation_json",
              "payload_preview", "captured_at_ms")
    return out.drop(*hidden)
