"""Registered queries: reputation, blocklists and sensor logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import intel, zeek
from packetloom.plans.adapters import adapt, table
from packetloom.plans.registry import query
from packetloom.sources import lists

_IP = ("concat(CAST(l_partkey % 256 AS {0}), '.', CAST(l_suppkey * 7 % 256 AS {0}), '.',"
       " CAST(l_orderkey % 256 AS {0}), '.', CAST(l_linenumber * 41 % 256 AS {0}))")
_NUM = ("(CAST(string_split({0}, '.')[1] AS BIGINT) * 16777216 + CAST(string_split({0}, '.')[2] AS BIGINT) * 65536"
        " + CAST(string_split({0}, '.')[3] AS BIGINT) * 256 + CAST(string_split({0}, '.')[4] AS BIGINT))")


_SPECIAL = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)


def _special(n: str) -> str:
    tests = []
    for cidr in _SPECIAL:
        base, length = cidr.split("/")
        a, b, c, d = (int(x) for x in base.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        tests.append(f"{n} BETWEEN {first} AND {first + 2 ** (32 - int(length)) - 1}")
    return "(" + " OR ".join(tests) + f") AND {n} NOT IN (3221225481, 3221225482)"


@query("t1_private", (), f"""
, i AS (SELECT DISTINCT {_IP.format('VARCHAR')} AS ip FROM lineitem), n AS (SELECT ip, {_NUM.format('ip')} AS n FROM i)
SELECT ip, {_special('n')} AS is_private FROM n
""")
def t1_private(spark, sf_dir):
    ips = table(spark, sf_dir, "lineitem").selectExpr(f"{_IP.format('STRING')} AS ip").distinct()
    return intel.with_private(ips, "ip")


_BLOCK = f"""
, lines AS (SELECT DISTINCT trim(string_split(trim(value), '#')[1]) AS value FROM blocklist_lines),
bl AS (SELECT value, string_split(value, '/')[1] AS base, CAST(coalesce(string_split(value, '/')[2], '32') AS INT) AS len
  FROM lines WHERE value <> ''),
nets AS (SELECT CAST(2 ** (32 - len) AS BIGINT) AS size, {_NUM.format('base')} AS n FROM bl),
ips AS (SELECT DISTINCT src_ip, {_NUM.format('src_ip')} AS n FROM packets),
hit AS (SELECT DISTINCT src_ip FROM ips, nets WHERE ips.n - ips.n % size = nets.n - nets.n % size)
"""


@query("s6_blocklist", ("blocklist_lines",), """
SELECT DISTINCT trim(string_split(trim(value), '#')[1]) AS value FROM blocklist_lines WHERE trim(string_split(trim(value), '#')[1]) <> ''
""")
def s6_blocklist(spark, sf_dir):
    return lists.parse_blocklist(adapt(spark, sf_dir, "blocklist_lines"))


def _blocklist(spark, sf_dir):
    return lists.parse_blocklist(adapt(spark, sf_dir, "blocklist_lines"))


@query("t2_blocklist_cidr", ("packets", "blocklist_lines"), _BLOCK + """
SELECT packet_id, src_ip IN (SELECT src_ip FROM hit) AS listed FROM packets
""")
def t2_blocklist_cidr(spark, sf_dir):
    return intel.match_blocklist(adapt(spark, sf_dir, "packets"), _blocklist(spark, sf_dir)).select(
        "packet_id", "listed"
    )


@query("t2_blocklist_exact", ("packets", "blocklist_lines"), _BLOCK + """
SELECT packet_id, src_ip IN (SELECT value FROM bl) AS listed FROM packets
""")
def t2_blocklist_exact(spark, sf_dir):
    return intel.match_blocklist(
        adapt(spark, sf_dir, "packets"), _blocklist(spark, sf_dir), exact=True
    ).select("packet_id", "listed")


_ABUSE = """SELECT indicator, 'abuseipdb' AS provider, CASE WHEN abuse_score >= 70 THEN 'malicious' WHEN abuse_score >= 30 THEN 'suspicious'
  ELSE 'safe' END AS verdict, least(1.0, greatest(0.0, abuse_score / 100)) AS score FROM abuse_feed"""
_META = """SELECT indicator, 'ip-api' AS provider, CASE WHEN proxy OR hosting THEN 'suspicious' ELSE 'safe' END AS verdict,
  CAST(CASE WHEN proxy THEN 0.45 WHEN hosting THEN 0.35 ELSE 0 END AS DOUBLE) AS score FROM meta_feed"""
_RANK = "CASE verdict WHEN 'malicious' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
_WORST = f"CASE greatest(max({_RANK}), 1) WHEN 3 THEN 'malicious' WHEN 2 THEN 'suspicious' ELSE 'unknown' END"
_POSITIVE = "max(CASE WHEN score > 0 THEN score END)"


@query("t3_abuse_verdict", ("abuse_feed",), _ABUSE)
def t3_abuse_verdict(spark, sf_dir):
    return intel.abuse_verdict(adapt(spark, sf_dir, "abuse_feed"))


@query("t4_meta_verdict", ("meta_feed",), _META)
def t4_meta_verdict(spark, sf_dir):
    return intel.meta_verdict(adapt(spark, sf_dir, "meta_feed"))


_VOTES = """SELECT indicator, 'virustotal' AS provider, CASE WHEN malicious > 0 THEN 'malicious' WHEN suspicious > 0 THEN 'suspicious'
  ELSE 'safe' END AS verdict, (malicious + suspicious * CAST(0.5 AS DOUBLE)) / greatest(1, malicious + suspicious + undetected) AS score FROM vote_feed"""


@query("t5_vote_verdict", ("vote_feed",), _VOTES)
def t5_vote_verdict(spark, sf_dir):
    return intel.vote_verdict(adapt(spark, sf_dir, "vote_feed"))


def _url_sql(url: str, source: str) -> str:
    domain = f"lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1))"
    return f"""
, d AS (SELECT *, {domain} AS domain FROM {source}),
h AS (SELECT *, CAST(greatest(CASE WHEN regexp_matches(domain, '\\.(tk|ml|ga|cf|gq|zip|mov)$') THEN 0.5 ELSE 0 END,
  CASE WHEN regexp_matches(lower({url}), 'login|verify|account|secure|update|wallet|php\\?') AND regexp_matches(domain, '[0-9]') THEN 0.55 ELSE 0 END,
  CASE WHEN length(domain) - length(replace(domain, '.', '')) >= 3 THEN 0.4 ELSE 0 END) AS DOUBLE) AS url_score FROM d),
v AS (SELECT *, CASE WHEN domain = '' THEN 'unknown' WHEN url_score > 0 THEN 'suspicious' ELSE 'safe' END AS url_verdict FROM h)
"""


@query("t6_t7_url_heuristics", (), """
, p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('http://Login', page_id, '.example.tk/x') WHEN 1
  THEN concat('https://u@a.b.c.example.org:8443/secure?p=', page_id) WHEN 2 THEN concat('http://h7.example/login.php?x=', page_id) ELSE url END AS url FROM pages)
""" + _url_sql("url", "p") + "SELECT page_id, domain, url_score, url_verdict FROM v")
def t6_t7_url_heuristics(spark, sf_dir):
    pid = F.col("page_id")
    url = (
        F.when(pid % 5 == 0, F.concat(F.lit("http://Login"), pid, F.lit(".example.tk/x")))
        .when(pid % 5 == 1, F.concat(F.lit("https://u@a.b.c.example.org:8443/secure?p="), pid))
        .when(pid % 5 == 2, F.concat(F.lit("http://h7.example/login.php?x="), pid)).otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return intel.url_heuristics(rows).drop("url")


@query("t8_merge_providers", ("abuse_feed", "meta_feed"), f"""
, f AS ({_ABUSE} UNION ALL {_META}),
each AS (SELECT indicator, provider, max(score) AS score, max({_RANK}) AS r FROM f GROUP BY indicator, provider)
SELECT f.indicator, {_WORST} AS verdict, {_POSITIVE} AS score, (SELECT string_agg(provider, ',' ORDER BY provider) FROM each e WHERE e.indicator = f.indicator) AS providers
FROM f GROUP BY f.indicator
""")
def t8_merge_providers(spark, sf_dir):
    found = intel.abuse_verdict(adapt(spark, sf_dir, "abuse_feed")).unionByName(
        intel.meta_verdict(adapt(spark, sf_dir, "meta_feed"))
    )
    names = F.array_join(F.transform("providers", lambda p: p["provider"]), ",")
    return intel.merge_providers(found).withColumn("providers", names)


_LOOKUP = _BLOCK + f"""
, f AS ({_ABUSE} UNION ALL {_META} UNION ALL SELECT src_ip, 'local_blocklist', 'malicious', 1.0 FROM hit),
m AS (SELECT indicator, {_WORST} AS verdict, {_POSITIVE} AS score FROM f GROUP BY indicator),
found AS (SELECT src_ip AS indicator, CASE WHEN {_special('n')} THEN 'local' ELSE 'aggregated' END AS provider,
  CASE WHEN {_special('n')} THEN 'safe' ELSE coalesce(verdict, 'unknown') END AS verdict,
  CASE WHEN {_special('n')} THEN 0.0 ELSE score END AS score FROM ips LEFT JOIN m ON ips.src_ip = m.indicator)
"""


@query("t9_lookup_ips", ("packets", "blocklist_lines", "abuse_feed", "meta_feed"), _LOOKUP + """
SELECT indicator, provider, verdict, score FROM found
""")
def t9_lookup_ips(spark, sf_dir):
    return intel.lookup_ips(
        adapt(spark, sf_dir, "packets"), _blocklist(spark, sf_dir),
        adapt(spark, sf_dir, "abuse_feed"), adapt(spark, sf_dir, "meta_feed"),
    ).select("indicator", "provider", "verdict", "score")


_URLS = """
, u AS (SELECT DISTINCT url FROM logs WHERE url IS NOT NULL)
""" + _url_sql("url", "u") + f"""
, vv AS ({_VOTES}),
uf AS (SELECT url AS indicator, url_verdict AS verdict, url_score AS score FROM v UNION ALL
  SELECT url, vv.verdict, vv.score FROM v JOIN vv ON vv.indicator = v.domain),
um AS (SELECT indicator, {_WORST} AS verdict, {_POSITIVE} AS score FROM uf GROUP BY indicator)
"""


@query("t10_lookup_urls", ("logs", "vote_feed"), _URLS + "SELECT indicator, verdict, score FROM um")
def t10_lookup_urls(spark, sf_dir):
    return intel.lookup_urls(adapt(spark, sf_dir, "logs"), adapt(spark, sf_dir, "vote_feed")).select(
        "indicator", "verdict", "score"
    )


# A cache log: every tenth packet writes an entry for its source that is valid for 6 hours.
_WRITES = """
, w AS (SELECT src_ip AS lookup_key, 'ip' AS lookup_type, ts_us AS cached_us, ts_us + 21600000000 * (1 + packet_id % 3) AS expires_us,
  CASE packet_id % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'safe' END AS verdict,
  CAST((packet_id % 10) / 10.0 AS DOUBLE) AS score FROM packets WHERE packet_id % 5 = 0)
"""


def _writes(spark, sf_dir):
    return adapt(spark, sf_dir, "packets").where(F.col("packet_id") % 5 == 0).selectExpr(
        "src_ip AS lookup_key", "'ip' AS lookup_type", "ts_us AS cached_us",
        "ts_us + 21600000000 * (1 + packet_id % 3) AS expires_us",
        "CASE packet_id % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'safe' END AS verdict",
        "CAST((packet_id % 10) / 10.0 AS DOUBLE) AS score",
    )


@query("t11_cache_as_of", ("packets",), _WRITES + """
SELECT p.packet_id, CASE WHEN w.expires_us > p.ts_us THEN w.verdict END AS verdict, CASE WHEN w.expires_us > p.ts_us THEN w.score END AS score
FROM packets p ASOF LEFT JOIN w ON p.src_ip = w.lookup_key AND p.ts_us >= w.cached_us
""")
def t11_cache_as_of(spark, sf_dir):
    events = adapt(spark, sf_dir, "packets").withColumns(
        {"lookup_key": F.col("src_ip"), "lookup_type": F.lit("ip")}
    )
    return intel.cache_as_of(events, _writes(spark, sf_dir)).select(
        "packet_id", "cached.verdict", "cached.score"
    )


_T11_NOW = 1_705_000_000_000_000
_PUT = _WRITES + f"""
, c AS (SELECT lookup_key, lookup_type, arg_max(verdict, cached_us) AS verdict, arg_max(score, cached_us) AS score,
  max(cached_us) AS cached_us FROM w GROUP BY lookup_key, lookup_type)
"""


def _cache(spark, sf_dir):
    rows = _writes(spark, sf_dir).select(
        "lookup_key", "lookup_type", "verdict", "score",
        F.timestamp_micros("cached_us").alias("cached_at"),
    )
    late = F.unix_micros("cached_at") >= _T11_NOW - 864_000_000_000
    empty = rows.limit(0).withColumn("expires_at", F.col("cached_at"))
    return intel.cache_put(intel.cache_put(empty, rows.where(~late)), rows.where(late), ttl_s=3600)


@query("t12_cache_put", ("packets",), _PUT + """
SELECT lookup_key, lookup_type, verdict, score, cached_us, cached_us + 3600000000 AS expires_us FROM c
""")
def t12_cache_put(spark, sf_dir):
    return _cache(spark, sf_dir).select(
        "lookup_key", "lookup_type", "verdict", "score", F.unix_micros("cached_at").alias("cached_us"),
        F.unix_micros("expires_at").alias("expires_us"),
    )


@query("t11_cache_get", ("packets",), _PUT + f"""
, k AS (SELECT DISTINCT src_ip FROM packets), t AS (SELECT max(cached_us) - 86400000000 AS now FROM c)
SELECT src_ip AS lookup_key, CASE WHEN cached_us + 3600000000 > (SELECT now FROM t) THEN verdict END AS verdict
FROM k LEFT JOIN c ON k.src_ip = c.lookup_key
""")
def t11_cache_get(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    keys = adapt(spark, sf_dir, "packets").select(
        F.col("src_ip").alias("lookup_key"), F.lit("ip").alias("lookup_type")
    ).distinct()
    newest = cache.agg(F.timestamp_micros(F.max(F.unix_micros("cached_at")) - 86_400_000_000)).scalar()
    return intel.cache_get(keys, cache, newest).select("lookup_key", "cached.verdict")


@query("t13_enrich", ("packets", "logs", "blocklist_lines", "abuse_feed", "meta_feed", "vote_feed"), _LOOKUP + _URLS + """
, r AS (SELECT id, logs.src_ip, logs.url, coalesce(ai_score, 0) AS adjusted_score, CASE id % 40 WHEN 0 THEN 'flood' WHEN 1 THEN 'dns' END AS behavior,
  src_ip IN (SELECT src_ip FROM hit) AND src_ip NOT LIKE '10.%' AS blocked FROM logs),
g AS (SELECT *, adjusted_score >= 0.25 OR coalesce(behavior = 'flood', false) OR blocked AS open FROM r),
i AS (SELECT g.*, CASE WHEN blocked THEN 'malicious' WHEN open THEN found.verdict END AS ip_verdict,
  CASE WHEN blocked THEN 1.0 WHEN open THEN found.score END AS ip_score FROM g LEFT JOIN found ON g.src_ip = found.indicator),
x AS (SELECT i.*, CASE WHEN open AND url IS NOT NULL AND (adjusted_score >= 0.45 OR coalesce(ip_verdict IN ('suspicious', 'malicious'), false))
  THEN um.verdict END AS url_verdict FROM i LEFT JOIN um ON i.url = um.indicator)
SELECT id, ip_verdict, ip_score, url_verdict, concat_ws(',', CASE WHEN ip_verdict <> 'unknown' THEN concat('reputation_ip_', ip_verdict) END,
  CASE WHEN url_verdict <> 'unknown' THEN concat('reputation_url_', url_verdict) END) AS intel_reasons FROM x
""")
def t13_enrich(spark, sf_dir):
    rows = adapt(spark, sf_dir, "logs").select(
        "id", "src_ip", "url", F.coalesce("ai_score", F.lit(0.0)).alias("adjusted_score"),
        F.when(F.col("id") % 40 == 0, "flood").when(F.col("id") % 40 == 1, "dns").alias("behavior"),
    )
    return intel.enrich(
        rows, _blocklist(spark, sf_dir), adapt(spark, sf_dir, "abuse_feed"),
        adapt(spark, sf_dir, "meta_feed"), adapt(spark, sf_dir, "vote_feed"),
    ).select(
        "id", F.col("ti_ip.verdict").alias("ip_verdict"), F.col("ti_ip.score").alias("ip_score"),
        F.col("ti_url.verdict").alias("url_verdict"), F.array_join("intel_reasons", ",").alias("intel_reasons"),
    )


# ---- sensor logs ----------------------------------------------------------------------

_ENDS = """
, ends AS (SELECT *, orig_h AS ip FROM zeek_conn UNION ALL SELECT *, resp_h AS ip FROM zeek_conn WHERE resp_h <> orig_h)
"""


@query("z1_by_endpoint", ("zeek_conn",), _ENDS + "SELECT ip, uid FROM ends")
def z1_by_endpoint(spark, sf_dir):
    return zeek.by_endpoint(adapt(spark, sf_dir, "zeek_conn")).select("ip", "uid")


@query("z1_newest_by_endpoint", ("zeek_conn",), _ENDS + """
, r AS (SELECT ip, uid, row_number() OVER (PARTITION BY ip ORDER BY uid DESC) AS n FROM ends)
SELECT ip, uid FROM r WHERE n <= 40
""")
def z1_newest_by_endpoint(spark, sf_dir):
    return zeek.by_endpoint(adapt(spark, sf_dir, "zeek_conn"), cap=40, order="uid").select("ip", "uid")


_PROFILE = _ENDS + """
, c AS (SELECT ip, count(*) AS conns, count(*) FILTER (WHERE contains(conn_state, 'REJ') OR coalesce(try_cast(resp_bytes AS DOUBLE), 0) < 1) AS rejected,
  count(*) FILTER (WHERE coalesce(try_cast(duration AS DOUBLE), 0) < 0.5 AND proto IN ('tcp', 'udp')) AS short_lived,
  count(*) FILTER (WHERE starts_with(conn_state, 'S0') OR conn_state = 'SH') AS syn_only, count(DISTINCT resp_p) AS resp_ports FROM ends GROUP BY ip),
prof AS (SELECT *, CAST(greatest(CASE WHEN rejected / conns > 0.5 THEN 0.7 WHEN rejected > 5 THEN 0.55 ELSE 0 END,
  CASE WHEN resp_ports >= 15 THEN 0.75 WHEN resp_ports >= 8 THEN 0.5 ELSE 0 END, CASE WHEN short_lived > 10 THEN 0.45 ELSE 0 END,
  CASE WHEN syn_only > 8 THEN 0.6 ELSE 0 END) AS DOUBLE) AS score,
  concat_ws(',', CASE WHEN rejected / conns > 0.5 THEN 'zeek_high_reject_ratio' WHEN rejected > 5 THEN 'zeek_many_rejected_conns' END,
  CASE WHEN resp_ports >= 15 THEN 'zeek_port_scan' WHEN resp_ports >= 8 THEN 'zeek_many_target_ports' END,
  CASE WHEN short_lived > 10 THEN 'zeek_short_connections' END, CASE WHEN syn_only > 8 THEN 'zeek_syn_scan_pattern' END) AS signals FROM c)
"""


@query("z2_conn_profile", ("zeek_conn",), _PROFILE + "SELECT * FROM prof")
def z2_conn_profile(spark, sf_dir):
    ends = zeek.by_endpoint(adapt(spark, sf_dir, "zeek_conn"))
    return zeek.conn_profile(ends).withColumn("signals", F.array_join("signals", ","))


_NOTICE = """
, hits AS (SELECT uid, unnest([orig_h, resp_h, src, dst]) AS ip, lower(coalesce(nullif(note, ''), msg)) AS note FROM zeek_notice),
risky AS (SELECT ip, note, count(*) AS n, min(uid) AS first_uid, regexp_matches(note, 'scan|brute|attack|exploit|malware|dos|ddos|infection|sql|shell') AS bad FROM hits WHERE ip NOT IN ('', '-') GROUP BY ip, note),
nt AS (SELECT ip, CAST(sum(n) AS BIGINT) AS notices, CAST(CASE WHEN bool_or(bad) THEN 0.85 ELSE 0.4 END AS DOUBLE) AS score,
  coalesce(string_agg(concat('zeek_notice_', note), ',' ORDER BY first_uid, note) FILTER (WHERE bad), 'zeek_notice_activity') AS signals FROM risky GROUP BY ip)
"""


@query("z3_notices", ("zeek_notice",), _NOTICE + "SELECT ip, notices, score, signals FROM nt")
def z3_notices(spark, sf_dir):
    return zeek.notices(adapt(spark, sf_dir, "zeek_notice"), order="uid").withColumn("signals", F.array_join("signals", ","))


_WEIRD = """
, odd AS (SELECT unnest([orig_h, resp_h, src, dst]) AS ip FROM zeek_weird),
wd AS (SELECT ip, count(*) AS weird, CAST(CASE WHEN count(*) > 20 THEN 0.7 WHEN count(*) > 5 THEN 0.5 ELSE 0.35 END AS DOUBLE) AS score,
  CASE WHEN count(*) > 20 THEN 'zeek_weird_activity,zeek_heavy_weird' ELSE 'zeek_weird_activity' END AS signals
  FROM odd WHERE ip NOT IN ('', '-') GROUP BY ip)
"""


@query("z4_weird", ("zeek_weird",), _WEIRD + "SELECT * FROM wd")
def z4_weird(spark, sf_dir):
    return zeek.weird(adapt(spark, sf_dir, "zeek_weird")).withColumn("signals", F.array_join("signals", ","))


@query("z5_zeek_verdict", ("zeek_conn", "zeek_notice", "zeek_weird"), _PROFILE + _NOTICE + _WEIRD + """
, parts AS (SELECT 0 AS k, ip, score, signals FROM prof UNION ALL SELECT 1, ip, score, signals FROM nt UNION ALL SELECT 2, ip, score, signals FROM wd),
sig AS (SELECT ip, k, s, i FROM parts, unnest(string_split(signals, ',')) WITH ORDINALITY AS u(s, i) WHERE s <> ''),
firsts AS (SELECT ip, s, min(k * 1000 + i) AS o FROM sig GROUP BY ip, s),
joined AS (SELECT ip, string_agg(s, ',' ORDER BY o) AS signals FROM firsts GROUP BY ip),
f AS (SELECT ip, max(score) AS score, min(k) AS k FROM parts GROUP BY ip)
SELECT f.ip, CASE WHEN score >= 0.7 THEN 'malicious' WHEN score >= 0.4 THEN 'suspicious' WHEN k < 2 THEN 'safe' ELSE 'unknown' END AS verdict,
  score, coalesce(signals, '') AS signals, CASE WHEN score >= 0.7 THEN 'zeek_flag_dangerous' WHEN score >= 0.4 THEN 'zeek_flag_suspicious' END AS reason
FROM f LEFT JOIN joined ON f.ip = joined.ip
""")
def z5_zeek_verdict(spark, sf_dir):
    found = zeek.zeek_verdict(
        adapt(spark, sf_dir, "zeek_conn"), adapt(spark, sf_dir, "zeek_notice"), adapt(spark, sf_dir, "zeek_weird"),
        order="uid",
    )
    return found.withColumn("signals", F.array_join("signals", ","))


@query("s7_zeek_lines", ("zeek_conn",), """
SELECT orig_h, resp_h, resp_p, conn_state FROM zeek_conn WHERE uid % 13 <> 0
""")
def s7_zeek_lines(spark, sf_dir):
    conn = adapt(spark, sf_dir, "zeek_conn")
    broken = F.col("uid") % 13 == 0
    row = F.concat_ws("\t", "orig_h", "resp_h", "resp_p", "conn_state")
    lines = conn.select(F.when(broken, F.concat(row, F.lit("\textra"))).otherwise(row).alias("value"))
    header = conn.limit(1).select(
        F.explode(F.array(F.lit("#separator x"), F.lit("#fields\tid.orig_h\tid.resp_h\tid.resp_p\tconn_state"))).alias("value")
    )
    whole = header.unionByName(lines)
    return lists.parse_zeek(whole, lists.zeek_fields(header))
