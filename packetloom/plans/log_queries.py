"""Registered queries: stored verdicts, alerts, upkeep and record normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import text, times
from packetloom.operators import alerts, logs, maintain
from packetloom.plans.adapters import adapt, table
from packetloom.plans.registry import query

DAY_S = 86_400
DAY_US = DAY_S * 1_000_000
T0 = 1_704_067_200  # 2024-01-01, where the test events begin
START, END = T0 + 2 * DAY_S + 30.5, T0 + 9 * DAY_S + 10.25
NOW = T0 + 20 * DAY_S + 7

_LABEL = "CASE WHEN lower(classification) IN ('suspicious', 'dangerous') THEN lower(classification) ELSE 'safe' END"
_EFFECTIVE = """CASE WHEN classification IN ('safe', 'suspicious', 'dangerous') THEN classification
  WHEN coalesce(risk_score, ai_score) >= 0.78 THEN 'dangerous'
  WHEN coalesce(risk_score, ai_score) >= 0.52 THEN 'suspicious' ELSE 'safe' END"""
_RAW_TREND = """coalesce(ai_score, risk_score, CASE classification WHEN 'dangerous' THEN 0.9
  WHEN 'suspicious' THEN 0.55 ELSE 0.08 END)"""
_TREND = f"""coalesce(ai_score, risk_score, CASE {_EFFECTIVE} WHEN 'dangerous' THEN 0.9
  WHEN 'suspicious' THEN 0.55 ELSE 0.08 END)"""
_HOST = "regexp_extract(url, '^http://([^/:]*)', 1)"


def _counts(label: str = "label") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = '{c}') AS {c}" for c in ("safe", "suspicious", "dangerous")
    )


def _logs(spark, sf_dir):
    return adapt(spark, sf_dir, "logs")


_ROW = "id, src_ip, classification, ai_score"


@query("q1_search_mixed", ("logs",), f"""
SELECT {_ROW} FROM logs WHERE (src_ip = '100.128.0.8' OR dst_ip = '100.128.0.8') AND upper(protocol) = 'TCP'
  AND contains(lower(url), 'example.net') AND list_contains(reasons, 'base')
  AND ts_sec >= {START} AND ts_sec <= {END}
""")
def q1_search_mixed(spark, sf_dir):
    return logs.search(
        _logs(spark, sf_dir), ip="100.128.0.8", protocol=" tcp ", url="EXAMPLE.net", reason="bas",
        start_time=START, end_time=END, min_ai_score=0,
    ).select("id", "src_ip", "classification", "ai_score")


@query("q1_search_scores", ("logs",), f"""
SELECT {_ROW} FROM logs WHERE ai_score >= 0.1 AND ai_score <= 0.7 AND anomaly_score >= 0.2 AND anomaly_score <= 0.9
  AND confidence >= 0.1 AND confidence <= 0.95 AND ts_sec < {END} AND intel_verdict IS NOT NULL
""")
def q1_search_scores(spark, sf_dir):
    return logs.search(
        _logs(spark, sf_dir), min_ai_score=0.1, max_ai_score=0.7, min_anomaly_score=0.2,
        max_anomaly_score=0.9, min_confidence=0.1, max_confidence=0.95, before_time=END,
        has_threat_intel="yes", intel=("intel_verdict",),
    ).select("id", "src_ip", "classification", "ai_score")


@query("q1_search_ports", ("logs",), f"""
SELECT {_ROW} FROM logs WHERE (src_port = 443 OR dst_port = 443) AND dst_port = 443 AND ai_label = 'safe'
  AND classification = 'safe' AND intel_verdict IS NULL AND dst_ip = '100.200.0.3'
""")
def q1_search_ports(spark, sf_dir):
    return logs.search(
        _logs(spark, sf_dir), port=443, dst_port=443, ai_label="safe", classification="safe",
        has_threat_intel="no", intel=("intel_verdict",), dst_ip="100.200.0.3",
    ).select("id", "src_ip", "classification", "ai_score")


@query("q2_newest", ("logs",), f"SELECT {_ROW} FROM logs ORDER BY ts_sec DESC, id DESC LIMIT 5000")
def q2_newest(spark, sf_dir):
    return logs.newest(_logs(spark, sf_dir), 5000).select("id", "src_ip", "classification", "ai_score")


_CURSOR = (float(T0 + 12 * DAY_S), 5_000)


@query("q3_page", ("logs",), f"""
SELECT {_ROW} FROM logs WHERE ts_sec < {_CURSOR[0]} OR (ts_sec = {_CURSOR[0]} AND id < {_CURSOR[1]})
ORDER BY ts_sec DESC, id DESC LIMIT 200
""")
def q3_page(spark, sf_dir):
    return logs.page(_logs(spark, sf_dir), 200, after=_CURSOR).select(
        "id", "src_ip", "classification", "ai_score"
    )


@query("q3_next_cursor", ("logs",), f"""
, p AS (SELECT ts_sec, id FROM logs WHERE ts_sec < {_CURSOR[0]} ORDER BY ts_sec DESC, id DESC LIMIT 50)
SELECT ts_sec AS next_time, id AS next_id FROM p ORDER BY ts_sec, id LIMIT 1
""")
def q3_next_cursor(spark, sf_dir):
    return logs.next_cursor(logs.page(_logs(spark, sf_dir), 50, after=_CURSOR))


@query("q4_window_totals", ("logs",), f"""
, l AS (SELECT *, {_LABEL} AS label FROM logs WHERE ts_sec >= {START} AND ts_sec <= {END})
SELECT count(*) AS total, {_counts()}, count(DISTINCT src_ip) FILTER (WHERE label = 'dangerous') AS unique_attackers FROM l
""")
def q4_window_totals(spark, sf_dir):
    return logs.window_totals(_logs(spark, sf_dir), START, END)


@query("q4_dangerous_sources", ("logs",), f"""
SELECT DISTINCT src_ip FROM logs WHERE classification = 'dangerous' AND ts_sec >= {START} AND ts_sec <= {END}
""")
def q4_dangerous_sources(spark, sf_dir):
    return logs.dangerous_sources(_logs(spark, sf_dir), START, END)


def _series_sql(where: str, seeds: str, bucket: str = "CAST(floor(ts_sec / 60) * 60 AS BIGINT)",
                label: str = _LABEL, score: str = _RAW_TREND) -> str:
    return f"""
, l AS (SELECT {bucket} AS bucket, {label} AS label, CAST(round(({score}) * 1000000) AS BIGINT) AS score FROM logs {where}),
g AS (SELECT bucket, count(*) AS total, {_counts()}, sum(score) AS s FROM l GROUP BY bucket),
series AS (SELECT coalesce(g.bucket, z.bucket) AS bucket, coalesce(safe, 0) AS safe, coalesce(suspicious, 0) AS suspicious,
  coalesce(dangerous, 0) AS dangerous, coalesce(total, 0) AS total,
  CASE WHEN total > 0 THEN CAST(s AS DOUBLE) / 1000000 / total ELSE 0.0 END AS avg_risk
  FROM g FULL JOIN ({seeds}) z ON g.bucket = z.bucket)
"""


_FIRST = int(START // 60) * 60
_SEEDS = f"SELECT {_FIRST} + 60 * range AS bucket FROM range({int(END // 60) - int(START // 60) + 1})"
_IN_RANGE = f"WHERE ts_sec >= {START} AND ts_sec <= {END}"
_SERIES = _series_sql(_IN_RANGE, _SEEDS)


@query("q5_timeseries", ("logs",), _SERIES + "SELECT *, true AS has_data FROM series")
def q5_timeseries(spark, sf_dir):
    return logs.timeseries(_logs(spark, sf_dir), START, END, digits=None)


@query("q7_timeseries_fallback", ("logs",), _series_sql(
    f"WHERE ts_sec >= {START} AND ts_sec <= {START + 600}", f"SELECT {_FIRST} + 60 * range AS bucket FROM range(11)"
) + "SELECT *, (SELECT sum(total) > 0 FROM series) AS has_data FROM series")
def q7_timeseries_fallback(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    history = rows.where(F.col("ts_sec") < START - DAY_S)
    return logs.timeseries(history, START, START + 600, minutes=60, logs=rows, digits=None)


@query("q8_series_totals", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs {_IN_RANGE}) SELECT {_counts()}, count(*) AS total FROM l
""")
def q8_series_totals(spark, sf_dir):
    return logs.series_totals(logs.timeseries(_logs(spark, sf_dir), START, END, digits=None))


@query("q9_q10_shown", ("logs",), f"SELECT id, {_EFFECTIVE} AS effective_class, {_TREND} AS trend_score FROM logs")
def q9_q10_shown(spark, sf_dir):
    return logs.with_shown(_logs(spark, sf_dir)).select("id", "effective_class", "trend_score")


@query("q11_top_ips", ("logs",), f"""
SELECT src_ip, max({_TREND}) AS score FROM logs GROUP BY src_ip ORDER BY score DESC, src_ip LIMIT 10
""")
def q11_top_ips(spark, sf_dir):
    return logs.top_ips(_logs(spark, sf_dir))


@query("q11_top_ips_newest", ("logs",), f"""
, n AS (SELECT * FROM logs ORDER BY ts_sec DESC, id DESC LIMIT 2000)
SELECT src_ip, max({_TREND}) AS score FROM n GROUP BY src_ip ORDER BY score DESC, src_ip LIMIT 10
""")
def q11_top_ips_newest(spark, sf_dir):
    return logs.top_ips(_logs(spark, sf_dir), row_limit=2000)


@query("q12_top_domains", ("logs",), f"""
SELECT {_HOST} AS host, max({_TREND}) AS score FROM logs WHERE url IS NOT NULL GROUP BY host ORDER BY score DESC, host LIMIT 10
""")
def q12_top_domains(spark, sf_dir):
    return logs.top_domains(_logs(spark, sf_dir))


@query("q12_top_domains_fallback", ("logs",), f"""
SELECT DISTINCT {_HOST} AS host, 1.0::DOUBLE AS score FROM logs WHERE url IS NOT NULL AND classification = 'dangerous'
ORDER BY host LIMIT 10
""")
def q12_top_domains_fallback(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    urls = rows.where(F.col("classification") == "dangerous").select("url")
    return logs.top_domains(rows.where(F.col("url").isNull()), dangerous_urls=urls)


@query("q13_page_hosts", (), """
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages
""")
def q13_page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.event_host(F.col("url")).alias("host"))


@query("q14_dns_timeline", ("logs",), """
SELECT CAST(floor(ts_sec / 60) * 60 AS BIGINT) AS bucket, count(*) AS suspect_dns FROM logs
WHERE list_contains(reasons, 'dns_long_qname') GROUP BY bucket
""")
def q14_dns_timeline(spark, sf_dir):
    return logs.dns_timeline(_logs(spark, sf_dir))


_DAY_FIRST = (NOW - 1440 * 60) // 60 * 60
_PLACED = f"least(greatest(CAST(floor(ts_sec / 60) * 60 AS BIGINT), {_DAY_FIRST}), {NOW // 60 * 60})"
_SEVERITY = _series_sql(
    "", f"SELECT {_DAY_FIRST} + 60 * range AS bucket FROM range(1440)", _PLACED, _EFFECTIVE, _TREND
)


@query("q15_severity_series", ("logs",), _SEVERITY + "SELECT * FROM series")
def q15_severity_series(spark, sf_dir):
    return logs.severity_series(_logs(spark, sf_dir), NOW, 1440)


@query("q16_spread_totals", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs), t AS (SELECT {_counts()} FROM l)
SELECT {_DAY_FIRST} + 60 * range AS bucket, safe / 1440 AS safe, suspicious / 1440 AS suspicious,
  dangerous / 1440 AS dangerous, safe / 1440 + suspicious / 1440 + dangerous / 1440 AS total FROM range(1440), t
""")
def q16_spread_totals(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    empty = rows.where(F.col("ts_sec") < 0)
    return logs.severity_series(empty, NOW, 1440, totals=logs.window_totals(rows)).select(
        "bucket", "safe", "suspicious", "dangerous", "total"
    )


@query("q17_distribution", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs), t AS (SELECT {_counts()} FROM l)
SELECT CAST(safe AS DOUBLE) AS safe, CAST(suspicious AS DOUBLE) AS suspicious, CAST(dangerous AS DOUBLE) AS dangerous FROM t
""")
def q17_distribution(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    empty = logs.timeseries(rows.where(F.col("ts_sec") < 0), START, END)
    totals = logs.series_totals(empty)
    return logs.distribution(totals, totals, logs.window_totals(rows), maintain.counters(rows))


@query("q18_risk_trend", ("logs",), _SERIES + "SELECT bucket, avg_risk FROM series")
def q18_risk_trend(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    series = logs.timeseries(rows, START, END, digits=None)
    return logs.risk_trend(series, logs.window_totals(rows))


@query("q18_risk_trend_inferred", ("logs",), f"""
, l AS (SELECT {_LABEL} AS label FROM logs), t AS (SELECT count(*) AS total, {_counts()} FROM l)
SELECT bucket, least(1.0, 0.2 + CAST(dangerous AS DOUBLE) / total * 0.75
  + CAST(suspicious AS DOUBLE) / total * 0.35) AS avg_risk FROM ({_SEEDS}), t
""")
def q18_risk_trend_inferred(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    flat = logs.timeseries(rows.where(F.col("ts_sec") < 0), START, END)
    return logs.risk_trend(flat, logs.window_totals(rows))


@query("q19_sorted", ("logs",), "SELECT id, url, src_ip FROM logs ORDER BY lower(url) DESC")
def q19_sorted(spark, sf_dir):
    return logs.sort_by(_logs(spark, sf_dir).select("id", "url", "src_ip"), "url")


@query("q20_free_text", ("logs",), """
SELECT id, src_ip FROM logs WHERE contains(lower(url), 'h3.example') OR list_contains(reasons, 'h3.example')
""")
def q20_free_text(spark, sf_dir):
    return logs.free_text(_logs(spark, sf_dir), " H3.Example").select("id", "src_ip")


@query("q21_last_range", ("logs",), f"""
SELECT id, ts_sec FROM logs WHERE ts_sec >= {NOW - 7 * DAY_S} AND ts_sec <= {NOW}
""")
def q21_last_range(spark, sf_dir):
    return logs.last(_logs(spark, sf_dir), "7d", float(NOW)).select("id", "ts_sec")


@query("q22_intel_summary", ("logs",), """
SELECT id, concat_ws(' · ', intel_verdict, 'feed', CASE WHEN id % 3 = 0 THEN concat('score=', id % 10) END) AS summary FROM logs
""")
def q22_intel_summary(spark, sf_dir):
    score = F.when(F.col("id") % 3 == 0, (F.col("id") % 10).cast("string"))
    line = text.intel_summary(
        {"verdict": F.col("intel_verdict"), "category": F.lit(""), "provider": F.lit("feed"), "score": score}
    )
    return _logs(spark, sf_dir).select("id", line.alias("summary"))


@query("q23_list_search", ("logs",), f"""
SELECT {_ROW} FROM logs WHERE (src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND contains(url, 'h5.example')
ORDER BY ts_sec DESC, id DESC LIMIT 200
""")
def q23_list_search(spark, sf_dir):
    found = logs.search(_logs(spark, sf_dir), ip="10.0.0.5", url="h5.example", case_sensitive=True)
    return logs.newest(found, 200).select("id", "src_ip", "classification", "ai_score")


@query("q24_offset_page", ("logs",), """
SELECT id, src_ip, url FROM logs WHERE contains(lower(url), 'h1.ex') OR contains(lower(src_ip), 'h1.ex')
ORDER BY src_ip, id DESC OFFSET 100 LIMIT 50
""")
def q24_offset_page(spark, sf_dir):
    return logs.offset_page(
        _logs(spark, sf_dir), q="H1.EX", cols=["url", "src_ip"], sort="src_ip", order="asc",
        page=3, page_size=50,
    ).select("id", "src_ip", "url")


@query("q24_matching_total", ("logs",), """
SELECT count(*) AS total FROM logs WHERE contains(lower(url), 'h1.ex') OR contains(lower(src_ip), 'h1.ex')
""")
def q24_matching_total(spark, sf_dir):
    return logs.matching(_logs(spark, sf_dir), "H1.ex", ["url", "src_ip"]).agg(F.count("*").alias("total"))


@query("s13_log_cache", ("logs",), "SELECT id, src_ip FROM logs ORDER BY ts_sec DESC, id DESC LIMIT 10000")
def s13_log_cache(spark, sf_dir):
    return logs.newest(_logs(spark, sf_dir), 10_000, cap=10_000).select("id", "src_ip")


# ---- alerts ---------------------------------------------------------------------------

_ELIGIBLE = """
, e AS (SELECT * FROM logs WHERE classification = 'dangerous' OR (classification = 'suspicious' AND risk_score >= 0.78)),
c AS (SELECT id, src_ip, ts_us, reasons, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us
  RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS burst_count FROM e)
"""
_FIRED = f"""
, cand AS (SELECT DISTINCT src_ip, ts_us, burst_count FROM c WHERE burst_count > 1),
fired AS (SELECT src_ip, min(ts_us) AS ts_us FROM cand GROUP BY src_ip
  UNION ALL
  SELECT src_ip, (SELECT min(x.ts_us) FROM cand x WHERE x.src_ip = fired.src_ip AND x.ts_us >= fired.ts_us + {2 * DAY_US}) AS ts_us
  FROM fired WHERE ts_us IS NOT NULL)
"""


@query("a1_eligible", ("logs",), _ELIGIBLE + "SELECT id FROM e")
def a1_eligible(spark, sf_dir):
    return alerts.eligible(_logs(spark, sf_dir)).select("id")


@query("a2_burst_counts", ("logs",), _ELIGIBLE + "SELECT id, src_ip, burst_count FROM c")
def a2_burst_counts(spark, sf_dir):
    return alerts.burst_counts(_logs(spark, sf_dir), 3 * DAY_S).select("id", "src_ip", "burst_count")


# DuckDB needs RECURSIVE for the greedy rule; every round finds the next alert of each source.
_REC = _FIRED.replace("fired AS (", "fired(src_ip, ts_us) AS (")


@query("a3_debounce", ("logs",), _ELIGIBLE + _REC + "SELECT src_ip, ts_us FROM fired WHERE ts_us IS NOT NULL")
def a3_debounce(spark, sf_dir):
    counted = alerts.burst_counts(_logs(spark, sf_dir), 3 * DAY_S).where(F.col("burst_count") > 1)
    return alerts.debounce(counted, 2 * DAY_S)


@query("a4_burst_alerts", ("logs",), _ELIGIBLE + _REC + f"""
, r AS (SELECT f.src_ip, f.ts_us, array_to_string(list_sort(list_distinct(flatten(list(e.reasons)))), ',') AS reasons
  FROM fired f JOIN e ON e.src_ip = f.src_ip AND e.ts_us BETWEEN f.ts_us - {3 * DAY_US} AND f.ts_us
  WHERE f.ts_us IS NOT NULL GROUP BY f.src_ip, f.ts_us)
SELECT r.src_ip, r.ts_us, burst_count, reasons FROM r JOIN cand ON cand.src_ip = r.src_ip AND cand.ts_us = r.ts_us
""")
def a4_burst_alerts(spark, sf_dir):
    fired = alerts.burst_alerts(_logs(spark, sf_dir), n=1, window_s=3 * DAY_S, gap_s=2 * DAY_S)
    return fired.withColumn("reasons", F.array_join("reasons", ","))


# ---- counters and upkeep --------------------------------------------------------------


@query("a5_counters", ("logs",), f", l AS (SELECT {_LABEL} AS label FROM logs) SELECT count(*) AS total, {_counts()} FROM l")
def a5_counters(spark, sf_dir):
    return maintain.counters(_logs(spark, sf_dir))


@query("a6_distinct_members", ("logs",), """
, d AS (SELECT src_ip, url FROM logs WHERE classification = 'dangerous')
SELECT DISTINCT 'unique_attackers' AS kind, src_ip AS member FROM d UNION ALL
SELECT DISTINCT 'dangerous_ips', src_ip FROM d UNION ALL
SELECT DISTINCT 'dangerous_urls', url FROM d WHERE url IS NOT NULL
""")
def a6_distinct_members(spark, sf_dir):
    return maintain.distinct_members(_logs(spark, sf_dir))


@query("a7_snapshot", ("logs",), f"""
, l AS (SELECT *, {_LABEL} AS label FROM logs)
SELECT 1 AS id, count(*) AS total, {_counts()}, count(DISTINCT src_ip) FILTER (WHERE label = 'dangerous') AS unique_attackers,
  count(DISTINCT src_ip) FILTER (WHERE label = 'dangerous') AS dangerous_ips,
  count(DISTINCT url) FILTER (WHERE label = 'dangerous') AS dangerous_urls FROM l
""")
def a7_snapshot(spark, sf_dir):
    return maintain.snapshot(_logs(spark, sf_dir))


@query("a8_merge_counters", ("logs",), f"""
, l AS (SELECT *, {_LABEL} AS label FROM logs),
n AS (SELECT count(*) AS total, {_counts()} FROM l WHERE id % 2 = 0), c AS (SELECT {_counts()} FROM l)
SELECT 1 AS id, n.total, c.safe, n.suspicious, c.dangerous FROM n, c
""")
def a8_merge_counters(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    current = maintain.snapshot(rows).select("id", "total", "safe", "suspicious", "dangerous")
    half = maintain.snapshot(rows.where(F.col("id") % 2 == 0))
    incoming = half.select("id", "total", "suspicious", F.lit(None).cast("long").alias("safe"))
    return maintain.merge_counters(current, incoming)


@query("a9_upsert_dangerous", ("logs",), """
SELECT src_ip AS ip_address, min(ts_sec) AS first_seen, max(ts_sec) AS last_seen, count(*) AS event_count,
  max(risk_score) AS max_risk_score, array_to_string(arg_max(reasons, (ts_sec, id)), ',') AS reasons
FROM logs WHERE classification = 'dangerous' GROUP BY src_ip
""")
def a9_upsert_dangerous(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    cut = F.col("ts_sec") < T0 + 15 * DAY_S
    merged = maintain.upsert_dangerous(
        maintain.dangerous_batch(rows.where(cut)), maintain.dangerous_batch(rows.where(~cut))
    )
    return merged.withColumn("reasons", F.array_join("reasons", ","))


@query("a10_retain", ("logs",), f"SELECT id FROM logs WHERE ts_sec >= {NOW - 7 * DAY_S}")
def a10_retain(spark, sf_dir):
    return maintain.retain(_logs(spark, sf_dir), NOW).select("id")


@query("a10_expired_counts", ("logs",), f"""
SELECT 'packet_logs' AS table_name, count(*) FILTER (WHERE ts_sec < {NOW - 7 * DAY_S}) AS dropped FROM logs
UNION ALL SELECT 'ai_history', count(*) FILTER (WHERE ts_sec < {NOW - 7 * DAY_S}) FROM logs
UNION ALL SELECT 'ti_cache', count(*) FILTER (WHERE ts_sec + 3600 < {NOW}) FROM logs
""")
def a10_expired_counts(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    cache = rows.select((F.col("ts_sec") + 3600).alias("expires_at"))
    return maintain.expired_counts(rows, rows, cache, NOW)


# ---- normalisation --------------------------------------------------------------------


@query("e1_event_time", (), f"""
, v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '-3' WHEN 2 THEN 'soon'
    WHEN 3 THEN CAST(1700000000000 + event_id AS VARCHAR) ELSE NULL END AS send,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS device FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN (1700000000000 + event_id) * 1e-3
  WHEN event_id % 3 = 0 AND event_id > 0 THEN CAST(event_id AS DOUBLE) ELSE {T0} END AS event_time FROM v
""")
def e1_event_time(spark, sf_dir):
    event_id = F.col("event_id")
    kind = event_id % 5
    send = F.when(kind == 0, "nan").when(kind == 1, "-3").when(kind == 2, "soon").when(
        kind == 3, (F.lit(1_700_000_000_000) + event_id).cast("string")
    )
    device = F.when(event_id % 3 == 0, event_id.cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", times.event_time(send, F.lit(None), device, now=F.lit(T0)).alias("event_time")
    )


@query("e2_millis", ("logs",), "SELECT id, CAST(round_even(ts_sec * 1000, 0) AS BIGINT) AS captured_at_ms FROM logs")
def e2_millis(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", times.millis(F.col("ts_sec")).alias("captured_at_ms"))


@query("e3_decode_reasons", (), """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('a', event_id, ',b') WHEN 1 THEN '' WHEN 2 THEN '_reasons_json_parse_error'
  WHEN 3 THEN concat('one', event_id) WHEN 4 THEN '' ELSE CAST(event_id AS VARCHAR) END AS reasons FROM events
""")
def e3_decode_reasons(spark, sf_dir):
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit('["a'), n, F.lit('", null, "b"]'))).when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit('["broken'), n)).when(kind == 3, F.concat(F.lit('"one'), n, F.lit('"')))
        .when(kind == 4, "null").otherwise(n)
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(text.decode_reasons(raw), ",").alias("reasons")
    )


@query("e4_decode_object", (), """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{"a": ', event_id, '}') WHEN 1 THEN NULL
  WHEN 2 THEN concat('{"_parse_error":true,"_raw":"{x', event_id, '"}') WHEN 3 THEN concat('{"value":[', event_id, ']}')
  WHEN 4 THEN NULL ELSE '{"value":null}' END AS object FROM events
""")
def e4_decode_object(spark, sf_dir):
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"a": '), n, F.lit("}"))).when(kind == 1, "{}")
        .when(kind == 2, F.concat(F.lit("{x"), n)).when(kind == 3, F.concat(F.lit("["), n, F.lit("]")))
        .when(kind == 4, "").otherwise("null")
    )
    return table(spark, sf_dir, "events").select("event_id", text.decode_object(raw).alias("object"))


@query("e5_log_view", ("logs",), """
SELECT id, src_ip, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'x' END, CAST(id AS VARCHAR)) AS reasons,
  CASE WHEN id % 3 = 0 THEN concat('{"verdict": "safe", "n": ', id, '}') END AS ti_ip FROM logs
""")
def e5_log_view(spark, sf_dir):
    n = F.col("id").cast("string")
    reasons = F.when(F.col("id") % 2 == 0, F.concat(F.lit('["x","'), n, F.lit('"]'))).otherwise(
        F.concat(F.lit('["'), n, F.lit('"]'))
    )
    intel = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"verdict": "safe", "n": '), n, F.lit("}")))
    stored = _logs(spark, sf_dir).select(
        "id", "src_ip", reasons.alias("reasons_json"), intel.alias("ti_ip_json"),
        F.lit("x").alias("payload_preview"),
    )
    return logs.log_view(stored).withColumn("reasons", F.array_join("reasons", ","))


@query("e6_ui_time", (), """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) / 1e6
  WHEN 1 THEN (1700000000000 + event_id) / 1000.0 WHEN 2 THEN CAST(event_id AS DOUBLE) END AS seconds FROM events
""")
def e6_ui_time(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, (F.lit(1_700_000_000_000) + n).cast("string"))
        .when(kind == 2, n.cast("string")).otherwise("not a time")
    )
    return table(spark, sf_dir, "events").select("event_id", times.parse_ui_time(shown).alias("seconds"))


@query("e7_keep_persistable", ("logs",), "SELECT id FROM logs WHERE classification <> 'safe'")
def e7_keep_persistable(spark, sf_dir):
    return maintain.keep_persistable(_logs(spark, sf_dir)).select("id")


@query("e8_systematic_sample", ("packets",), """
, r AS (SELECT packet_id, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id) AS n FROM packets)
SELECT packet_id FROM r WHERE n % 4 = 0
""")
def e8_systematic_sample(spark, sf_dir):
    return maintain.systematic_sample(adapt(spark, sf_dir, "packets"), 4).select("packet_id")


@query("m11_training_sample", ("logs",), f"""
SELECT id FROM logs WHERE {_LABEL} <> 'safe' OR (id * 7919) % 10000 < 200
""")
def m11_training_sample(spark, sf_dir):
    return maintain.training_sample(
        _logs(spark, sf_dir), "id", 0.02, pick="(id * 7919) % 10000"
    ).select("id")
