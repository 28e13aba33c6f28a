"""Registered queries: record normalisation, flows, behaviour and DNS."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import net, text
from packetloom.operators import behavior, dns, flows
from packetloom.plans.adapters import adapt, table
from packetloom.plans.registry import query

DAY_S = 86_400
DAY_US = DAY_S * 1_000_000
_CODE = "CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 ELSE 0 END"
_KEY = "src_ip, dst_ip, src_port, dst_port, protocol"


def _flow_columns(now: str) -> str:
    d = f"greatest(({now} - start_us) / 1e6, 1e-6)"
    return f"""
      start_us, CAST(dst_port AS BIGINT) AS destination_port, {d} * 1e6 AS flow_duration_us,
      n AS total_fwd_packets, 0 AS total_bwd_packets, b AS total_fwd_bytes, 0 AS total_bwd_bytes,
      b / {d} AS flow_bytes_per_s, n / {d} AS flow_packets_per_s, n / {d} AS fwd_packets_per_s,
      CAST(0 AS DOUBLE) AS bwd_packets_per_s,
      syn AS syn_flag_count, ack AS ack_flag_count, rst AS rst_flag_count,
      fin AS fin_flag_count, psh AS psh_flag_count, b / n AS packet_length_mean,
      sqrt(greatest(0.0, q / n - (b / n) * (b / n))) AS packet_length_std,
      CAST({_CODE} AS BIGINT) AS protocol_code"""


def _flow_sums(over: str) -> str:
    flags = ", ".join(
        f"CAST(sum(CASE WHEN contains(tcp_flags, '{letter}') THEN 1 ELSE 0 END){over} AS BIGINT) AS {name}"
        for name, letter in (("syn", "S"), ("ack", "A"), ("rst", "R"), ("fin", "F"), ("psh", "P"))
    )
    return (
        f"count(*){over} AS n, CAST(sum(bytes){over} AS BIGINT) AS b,"
        f" sum(CAST(bytes AS DOUBLE) * CAST(bytes AS DOUBLE)){over} AS q, {flags}"
    )


_SNAP = " OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING)"


@query("f1_running_flows", ("packets",), f"""
, wide AS (SELECT packet_id, ts_us, src_ip, dst_ip, 40000 AS src_port, 80 AS dst_port, protocol, tcp_flags, bytes FROM packets),
r AS (SELECT *, min(ts_us){_SNAP} AS start_us, {_flow_sums(_SNAP)} FROM wide)
SELECT packet_id, ts_us, {_KEY}, tcp_flags, bytes, {_flow_columns('ts_us')} FROM r
""")
def f1_running_flows(spark, sf_dir):
    # One port pair, so that flows have several packets.
    packets = adapt(spark, sf_dir, "packets").withColumns(
        {"src_port": F.lit(40000), "dst_port": F.lit(80)}
    )
    return flows.running_flows(packets)


@query("f2_flows", ("packets",), f"""
, g AS (SELECT {_KEY}, min(ts_us) AS start_us, max(ts_us) AS end_us, {_flow_sums('')}
  FROM packets GROUP BY {_KEY})
SELECT {_KEY}, end_us, {_flow_columns('end_us')} FROM g
""")
def f2_flows(spark, sf_dir):
    return flows.flows(adapt(spark, sf_dir, "packets"))


@query("f2_flows_bidirectional", ("packets",), """
, p AS (SELECT packet_id, ts_us, bytes, protocol,
    CASE WHEN packet_id % 3 = 0 THEN dst_ip ELSE src_ip END AS a_ip, 50 AS a_port,
    CASE WHEN packet_id % 3 = 0 THEN src_ip ELSE dst_ip END AS b_ip, 60 AS b_port FROM packets),
e AS (SELECT *, CASE WHEN a_ip < b_ip THEN a_ip ELSE b_ip END AS low_ip,
    CASE WHEN a_ip < b_ip THEN b_ip ELSE a_ip END AS high_ip FROM p),
g AS (SELECT low_ip, high_ip, protocol, arg_min(a_ip, (ts_us, packet_id)) AS first_ip,
    count(*) AS n, sum(bytes) AS b,
    count(*) FILTER (WHERE a_ip = low_ip) AS low_n, coalesce(sum(bytes) FILTER (WHERE a_ip = low_ip), 0) AS low_b
    FROM e GROUP BY low_ip, high_ip, protocol)
SELECT first_ip AS src_ip, CASE WHEN first_ip = low_ip THEN high_ip ELSE low_ip END AS dst_ip, protocol,
  CAST(CASE WHEN first_ip = low_ip THEN low_n ELSE n - low_n END AS BIGINT) AS total_fwd_packets,
  CAST(CASE WHEN first_ip = low_ip THEN n - low_n ELSE low_n END AS BIGINT) AS total_bwd_packets,
  CAST(CASE WHEN first_ip = low_ip THEN low_b ELSE b - low_b END AS BIGINT) AS total_fwd_bytes,
  CAST(CASE WHEN first_ip = low_ip THEN b - low_b ELSE low_b END AS BIGINT) AS total_bwd_bytes
FROM g
""")
def f2_flows_bidirectional(spark, sf_dir):
    turned = F.col("packet_id") % 3 == 0
    packets = adapt(spark, sf_dir, "packets").select(
        "packet_id", "ts_us", "bytes", "protocol", "tcp_flags",
        F.when(turned, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("src_ip"),
        F.when(turned, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("dst_ip"),
        F.lit(7).alias("src_port"), F.lit(7).alias("dst_port"),
    )
    return flows.flows(packets, bidirectional=True).select(
        "src_ip", "dst_ip", "protocol", "total_fwd_packets", "total_bwd_packets",
        "total_fwd_bytes", "total_bwd_bytes",
    )


@query("f3_flow_totals", ("packets",), f"""
SELECT {_KEY}, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM packets GROUP BY {_KEY}
""")
def f3_flow_totals(spark, sf_dir):
    return flows.flow_totals(adapt(spark, sf_dir, "packets"))


@query("f4_features", ("packets",), f"""
, g AS (SELECT {_KEY}, min(ts_us) AS start_us, max(ts_us) AS end_us, {_flow_sums('')}
  FROM packets GROUP BY {_KEY}),
f AS (SELECT {_KEY}, {_flow_columns('end_us')} FROM g)
SELECT {_KEY}, 18 AS n_features, CAST(destination_port AS DOUBLE) AS f_0, flow_duration_us AS f_1,
  CAST(total_fwd_packets AS DOUBLE) AS f_2, flow_bytes_per_s AS f_6, packet_length_std AS f_16,
  CAST(protocol_code AS DOUBLE) AS f_17 FROM f
""")
def f4_features(spark, sf_dir):
    f = F.col("features")
    return flows.features(flows.flows(adapt(spark, sf_dir, "packets"))).select(
        *flows.FLOW_KEY, F.size(f).alias("n_features"),
        *[f[i].alias(f"f_{i}") for i in (0, 1, 2, 6, 16, 17)],
    )


_CIC = """
, c AS (SELECT l_orderkey * 10 + l_linenumber AS rec_id,
    CASE WHEN l_linenumber % 5 = 0 THEN 'NaN' WHEN l_linenumber % 5 = 1 THEN 'Infinity'
      ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS v,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS syn,
    CASE l_linestatus WHEN 'O' THEN ' benign ' ELSE 'DDoS' END AS label FROM lineitem)
"""


def _cic_rows(spark, sf_dir):
    """Rows of a training CSV as they are read: text cells, padded headers."""
    value = F.when(F.col("l_linenumber") % 5 == 0, "NaN").when(
        F.col("l_linenumber") % 5 == 1, "Infinity"
    ).otherwise(F.col("l_quantity").cast("long").cast("string"))
    syn = F.when(F.col("l_returnflag") == "R", "1").otherwise("0")
    cells = {c: value for c in flows.CSV_COLUMNS.values()}
    cells |= {flows.CSV_COLUMNS[f"{n}_flag_count"]: F.lit("0") for n in ("ack", "rst", "fin", "psh")}
    cells[flows.CSV_COLUMNS["syn_flag_count"]] = syn
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"),
        *[cell.alias(f" {name}") for name, cell in cells.items()],
        F.when(F.col("l_linestatus") == "O", " benign ").otherwise("DDoS").alias(" Label"),
    )


@query("f6_csv_features", (), _CIC + """
SELECT rec_id, CASE WHEN v IN ('NaN', 'Infinity') THEN 0.0 ELSE CAST(v AS DOUBLE) END AS destination_port,
  CAST(syn AS DOUBLE) AS syn_flag_count, CAST(CASE WHEN syn > 0 THEN 1 ELSE 2 END AS DOUBLE) AS protocol_code,
  CASE WHEN upper(trim(label)) = 'BENIGN' THEN 0 ELSE 1 END AS label FROM c
""")
def f6_csv_features(spark, sf_dir):
    from packetloom.sources.training import labelled_csv

    return labelled_csv(_cic_rows(spark, sf_dir)).select(
        "rec_id", "destination_port", "syn_flag_count", "protocol_code", "label"
    )


@query("f5_clean", (), _CIC + """
SELECT rec_id, CASE WHEN v IN ('NaN', 'Infinity') THEN 0.0 ELSE CAST(v AS DOUBLE) END AS v FROM c
""")
def f5_clean(spark, sf_dir):
    rows = _cic_rows(spark, sf_dir).select(
        "rec_id", F.col("` Flow Duration`").cast("double").alias("v")
    )
    return flows.clean(rows, ["v"])


@query("f7_derive_protocol", (), """
SELECT l_orderkey * 10 + l_linenumber AS rec_id, CAST(CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS DOUBLE) AS mapped,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS by_flags FROM lineitem
""")
def f7_derive_protocol(spark, sf_dir):
    number = F.element_at(F.array(*[F.lit(n) for n in (6, 17, 1, 47, 0)]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    flags = {flows.CSV_COLUMNS[f"{n}_flag_count"]: F.lit(None).cast("string") for n in ("syn", "rst", "fin", "psh")}
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {**flags, flows.CSV_COLUMNS["ack_flag_count"]: (F.col("l_linenumber") % 3 == 0).cast("int")}
    )
    given = rows.withColumn("Protocol", number)
    return given.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"),
        flows.derive_protocol(given).alias("mapped"), flows.derive_protocol(rows).alias("by_flags"),
    )


@query("f9_port_class", ("packets",), f"""
, c AS (SELECT *, CASE WHEN dst_port IN (80, 443, 8080, 8443) THEN 'web' WHEN dst_port IN (53, 123) THEN 'dns_time'
    WHEN dst_port IN (22, 3389) THEN 'remote' ELSE 'unknown' END AS port_category FROM packets)
SELECT packet_id, port_category, CASE WHEN port_category = 'unknown' AND dst_port > 1024 THEN dst_port END AS unusual_port,
  (protocol = 'TCP' AND dst_port = 443) AS is_https, {_CODE} AS protocol_code,
  CASE WHEN protocol IN ('TCP', 'UDP', 'ICMP') THEN protocol ELSE 'OTHER' END AS protocol_name FROM c
""")
def f9_port_class(spark, sf_dir):
    code = net.protocol_code(F.col("protocol"))
    return flows.port_class(adapt(spark, sf_dir, "packets")).select(
        "packet_id", "port_category", "unusual_port", "is_https",
        code.alias("protocol_code"), net.protocol_name(code).alias("protocol_name"),
    )


@query("f10_byte_entropy", ("payloads",), """
SELECT payload_id, floor(list_entropy(regexp_extract_all(hex(encode(payload)), '..')) * 10000) / 10000 AS entropy
FROM payloads
""")
def f10_byte_entropy(spark, sf_dir):
    return adapt(spark, sf_dir, "payloads").select(
        "payload_id",
        (F.floor(text.byte_entropy(F.col("payload").cast("binary")) * 10000) / 10000).alias("entropy"),
    )


@query("f12_flag_bits", ("packets",), """
SELECT packet_id, CAST(contains(tcp_flags, 'S') AS INT) AS syn_flag, CAST(contains(tcp_flags, 'A') AS INT) AS ack_flag,
  CAST(contains(tcp_flags, 'R') AS INT) AS rst_flag, CAST(contains(tcp_flags, 'F') AS INT) AS fin_flag,
  CAST(contains(tcp_flags, 'P') AS INT) AS psh_flag FROM packets
""")
def f12_flag_bits(spark, sf_dir):
    return flows.flag_bits(adapt(spark, sf_dir, "packets")).select(
        "packet_id", "syn_flag", "ack_flag", "rst_flag", "fin_flag", "psh_flag"
    )


# ---- behaviour: the test events are sparse, so windows are days, not seconds ----------


def _range(us: int, key: str = "src_ip") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"


@query("b1_flood", ("packets",), f"""
, c AS (SELECT packet_id, src_ip, count(*) {_range(DAY_US)} AS recent_packets FROM packets)
SELECT packet_id, src_ip, recent_packets, recent_packets > 6 AS is_flood FROM c
""")
def b1_flood(spark, sf_dir):
    return behavior.flood(adapt(spark, sf_dir, "packets"), n=6, window_s=DAY_S).select(
        "packet_id", "src_ip", "recent_packets", "is_flood"
    )


@query("b2_port_scan", ("packets",), f"""
, c AS (SELECT packet_id, src_ip, count(DISTINCT dst_port) {_range(2 * DAY_US)} AS recent_ports FROM packets)
SELECT packet_id, src_ip, recent_ports, recent_ports >= 4 AS is_port_scan FROM c
""")
def b2_port_scan(spark, sf_dir):
    return behavior.port_scan(adapt(spark, sf_dir, "packets"), n=4, window_s=2 * DAY_S).select(
        "packet_id", "src_ip", "recent_ports", "is_port_scan"
    )


def _precedence(flood_n, flood_us, scan_n, scan_us, kept=""):
    near = f"OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id ROWS BETWEEN {flood_n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
, c AS (SELECT packet_id, src_ip, count(*) {_range(flood_us)} AS f, count(DISTINCT dst_port) {near} AS near,
    count(DISTINCT dst_port) {_range(scan_us)} AS p{kept} FROM packets)
SELECT packet_id, src_ip, CASE WHEN f > {flood_n} AND least(near, p) >= {scan_n} THEN 'port_scan'
  WHEN f > {flood_n} THEN 'flood' WHEN {'least(p, kept)' if kept else 'p'} >= {scan_n} THEN 'port_scan' END AS behavior FROM c
"""


@query("b3_behavior", ("packets",), _precedence(5, 2 * DAY_US, 4, 3 * DAY_US))
def b3_behavior(spark, sf_dir):
    return behavior.detect(
        adapt(spark, sf_dir, "packets"), flood_n=5, flood_s=2 * DAY_S, scan_n=4, scan_s=3 * DAY_S
    ).select("packet_id", "src_ip", "behavior")


@query("b3_behavior_reference_windows", ("packets",), _precedence(120, 3_000_000, 15, 8_000_000))
def b3_behavior_reference_windows(spark, sf_dir):
    return behavior.detect(adapt(spark, sf_dir, "packets")).select("packet_id", "src_ip", "behavior")


_KEPT = """, count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id
    ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS kept"""


@query("b4_behavior_history", ("packets",), _precedence(6, DAY_US, 5, 20 * DAY_US, _KEPT))
def b4_behavior_history(spark, sf_dir):
    return behavior.detect(
        adapt(spark, sf_dir, "packets"), flood_n=6, flood_s=DAY_S, scan_n=5, scan_s=20 * DAY_S, history=8
    ).select("packet_id", "src_ip", "behavior")


# ---- DNS ------------------------------------------------------------------------------

_NAMED = """
, q AS (SELECT dns_id, ts_us, src_ip, qname, qtype,
    CASE WHEN len(string_split(qname, '.')) <= 2 THEN lower(qname)
      ELSE lower(concat_ws('.', string_split(qname, '.')[-2], string_split(qname, '.')[-1])) END AS base,
    list_entropy(string_split(replace(qname, '.', ''), '')) AS e FROM dns)
"""


@query("b5_b6_dns_names", ("dns",), _NAMED + """
SELECT dns_id, base AS base_domain, floor(e * 10000) / 10000 AS name_entropy FROM q
""")
def b5_b6_dns_names(spark, sf_dir):
    return dns.with_names(adapt(spark, sf_dir, "dns")).select(
        "dns_id", "base_domain", (F.floor(F.col("name_entropy") * 10000) / 10000).alias("name_entropy")
    )


@query("b7_dns_flags", ("dns",), _NAMED + """
SELECT dns_id, length(qname) >= 24 AS long_qname, e >= 3.6 AS high_entropy, qtype = 'TXT' AS is_txt FROM q
""")
def b7_dns_flags(spark, sf_dir):
    return dns.dns_flags(adapt(spark, sf_dir, "dns"), long=24, entropy=3.6).select(
        "dns_id", "long_qname", "high_entropy", "is_txt"
    )


@query("b8_unique_queries", ("dns",), _NAMED + f"""
, c AS (SELECT dns_id, count(DISTINCT qname) {_range(DAY_US)} AS unique_qnames FROM q)
SELECT dns_id, unique_qnames, unique_qnames >= 12 AS many_unique FROM c
""")
def b8_unique_queries(spark, sf_dir):
    return dns.unique_queries(adapt(spark, sf_dir, "dns"), n=12, window_s=DAY_S).select(
        "dns_id", "unique_qnames", "many_unique"
    )


@query("b9_txt_burst", ("dns",), _NAMED + f"""
, c AS (SELECT dns_id, CAST(sum(CASE WHEN qtype = 'TXT' THEN 1 ELSE 0 END) {_range(DAY_US)} AS BIGINT) AS txt_queries FROM q)
SELECT dns_id, txt_queries, txt_queries >= 4 AS txt_burst FROM c
""")
def b9_txt_burst(spark, sf_dir):
    return dns.txt_burst(adapt(spark, sf_dir, "dns"), n=4, window_s=DAY_S).select(
        "dns_id", "txt_queries", "txt_burst"
    )


@query("b10_subdomain_churn", ("dns",), _NAMED + f"""
, per AS (SELECT a.dns_id, b.base, count(DISTINCT b.qname) AS d FROM q a JOIN q b
    ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - {DAY_US} AND a.ts_us GROUP BY a.dns_id, b.base)
SELECT dns_id, max(d) >= 10 AS subdomain_churn FROM per GROUP BY dns_id
""")
def b10_subdomain_churn(spark, sf_dir):
    return dns.subdomain_churn(adapt(spark, sf_dir, "dns"), n=10, window_s=DAY_S).select(
        "dns_id", "subdomain_churn"
    )


@query("b11_dns_reasons", ("dns",), _NAMED + f"""
, per AS (SELECT a.dns_id, b.base, count(DISTINCT b.qname) AS d FROM q a JOIN q b
    ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - {DAY_US} AND a.ts_us GROUP BY a.dns_id, b.base),
w AS (SELECT dns_id, max(d) >= 10 AS churn FROM per GROUP BY dns_id),
s AS (SELECT q.dns_id, length(qname) >= 24 AS l, e >= 3.6 AS h, qtype = 'TXT' AS t, churn,
    count(DISTINCT qname) {_range(DAY_US)} >= 12 AS u,
    sum(CASE WHEN qtype = 'TXT' THEN 1 ELSE 0 END) {_range(DAY_US)} >= 4 AS b FROM q JOIN w ON q.dns_id = w.dns_id)
SELECT dns_id, concat_ws(',', CASE WHEN l THEN 'dns_long_qname' END, CASE WHEN h THEN 'dns_high_entropy_qname' END,
  CASE WHEN t THEN 'dns_txt_query' END, CASE WHEN u THEN 'dns_many_unique_queries' END,
  CASE WHEN b THEN 'dns_txt_burst' END, CASE WHEN churn THEN 'dns_subdomain_churn' END,
  CASE WHEN (h AND u) OR (churn AND l) THEN 'dns_tunnel_suspected' END) AS dns_reasons FROM s
""")
def b11_dns_reasons(spark, sf_dir):
    return dns.dns_reasons(
        adapt(spark, sf_dir, "dns"), window_s=DAY_S, long=24, entropy=3.6, unique=12, txt=4, churn=10
    ).select("dns_id", F.array_join("dns_reasons", ",").alias("dns_reasons"))


@query("c3_dns_queries", ("dns",), "SELECT dns_id, qname FROM dns WHERE qr = 0 AND qdcount > 0")
def c3_dns_queries(spark, sf_dir):
    return dns.dns_queries(adapt(spark, sf_dir, "dns")).select("dns_id", "qname")
