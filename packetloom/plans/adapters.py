"""Detection tables derived from the driver's Parquet tables, in Spark and in SQL.

Each adapter lists its columns once; a few spellings differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.session import configure

_SPARK = {
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "S": "STRING",
    "K": "CAST(get_json_object(props, '$.k') AS INT)",
    "SPLIT": "split",
    "D": "DOUBLE",
    "BLOB": "CAST({} AS BINARY)",
}
_DUCK = {
    "US": "epoch_us(ts)",
    "S": "VARCHAR",
    "K": "CAST(json_extract_string(props, '$.k') AS INT)",
    "SPLIT": "string_split",
    "D": "DOUBLE",
}

_SRC = ("concat(CASE WHEN user_id % 5 = 0 THEN '10.0.0.' ELSE '100.128.0.' END,"
        " CAST(user_id % 256 AS <S>))")
_DST = "concat('100.200.0.', CAST(event_id % 16 AS <S>))"

_COLUMNS: dict[str, tuple[str, dict[str, str]]] = {
    "packets": ("events", {
        "packet_id": "event_id",
        "ts_us": "<US>",
        "src_ip": _SRC,
        "dst_ip": _DST,
        "src_port": "CAST(40000 + event_id % 1000 AS INT)",
        "dst_port": "CAST(CASE <K> % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22"
                    " WHEN 4 THEN 2000 + <K> ELSE 8080 END AS INT)",
        "protocol": "CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'TCP'"
                    " WHEN 'purchase' THEN 'UDP' WHEN 'signup' THEN 'ICMP' ELSE 'OTHER' END",
        "tcp_flags": "CASE WHEN event_type IN ('click', 'view') THEN CASE event_id % 4 WHEN 0 THEN 'S'"
                     " WHEN 1 THEN 'SA' WHEN 2 THEN 'PA' ELSE 'FA' END ELSE '' END",
        "bytes": "CAST(floor(value) AS BIGINT) + 40",
    }),
    "logs": ("events", {
        "id": "event_id",
        "ts_sec": "CAST(<US> AS DOUBLE) / 1e6",
        "ts_us": "<US>",
        "src_ip": _SRC,
        "dst_ip": _DST,
        "src_port": "CAST(40000 + event_id % 1000 AS INT)",
        "dst_port": "CAST(CASE <K> % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22"
                    " WHEN 4 THEN 2000 + <K> ELSE 8080 END AS INT)",
        "protocol": "CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'TCP'"
                    " WHEN 'purchase' THEN 'UDP' WHEN 'signup' THEN 'ICMP' ELSE 'OTHER' END",
        "url": "CASE WHEN event_id % 3 = 0 THEN concat('http://h', CAST(user_id % 9 AS <S>),"
               " '.example.net:8080/p?id=', CAST(event_id AS <S>)) END",
        "classification": "CASE WHEN event_id % 50 = 0 THEN 'odd' WHEN value >= 150 THEN 'dangerous'"
                          " WHEN value >= 100 THEN 'suspicious' ELSE 'safe' END",
        "ai_label": "CASE WHEN value >= 120 THEN 'dangerous' WHEN value >= 80 THEN 'suspicious'"
                    " ELSE 'safe' END",
        "ai_score": "CASE WHEN event_id % 7 = 0 THEN NULL"
                    " ELSE CAST(least(floor(value * 10000 / 192) / 10000, 1) AS <D>) END",
        "risk_score": "CASE WHEN event_id % 49 = 0 THEN NULL"
                      " ELSE CAST(least(floor(value * 10000 / 180) / 10000, 1) AS <D>) END",
        "anomaly_score": "CASE WHEN event_id % 11 = 0 THEN NULL"
                         " ELSE CAST((event_id % 100) / 100.0 AS <D>) END",
        "confidence": "CAST(((event_id * 7) % 100) / 100.0 AS <D>)",
        "reasons": "<SPLIT>(concat_ws(',', CASE WHEN value >= 100 THEN 'ml_attack' END,"
                   " CASE WHEN event_type = 'error' THEN 'dns_long_qname' END,"
                   " CASE WHEN event_id % 5 = 0 THEN 'unusual_port_4444' END, 'base'), ',')",
        "intel_verdict": "CASE WHEN event_id % 13 = 0 THEN 'malicious'"
                         " WHEN event_id % 13 = 1 THEN 'suspicious' END",
    }),
    "dns": ("events", {
        "dns_id": "event_id",
        "ts_us": "<US>",
        "src_ip": "concat('10.0.0.', CAST(user_id % 40 AS <S>))",
        "qname": "concat(event_type, '-', CAST(event_id % 97 AS <S>), '.t', CAST(user_id % 3 AS <S>),"
                 " '.example.net')",
        "qtype": "CASE WHEN event_id % 4 = 0 THEN 'TXT' ELSE 'A' END",
        "qr": "CAST(event_id % 3 % 2 AS INT)",
        "qdcount": "CAST(event_id % 5 AS INT)",
    }),
    "payloads": ("documents", {
        "payload_id": "doc_id",
        "payload": "concat(text, CASE doc_id % 11 WHEN 0 THEN ' id=1 UNION  SELECT x'"
                   " WHEN 1 THEN ' <script>alert(1)</script>' WHEN 2 THEN ' ;cat /etc/passwd'"
                   " WHEN 3 THEN ' php://input' WHEN 4 THEN ' http://169.254.169.254/'"
                   " WHEN 5 THEN ' token=abc' WHEN 6 THEN ' certutil' WHEN 7 THEN ' sqlmap'"
                   " WHEN 8 THEN ' AAAA' WHEN 9 THEN ' %2e%2e%2fetc' ELSE '' END)",
    }),
    "zeek_conn": ("lineitem", {
        "uid": "l_orderkey * 10 + l_linenumber",
        "orig_h": "concat('10.1.0.', CAST(l_suppkey % 256 AS <S>))",
        "resp_h": "concat('10.2.0.', CAST(l_partkey % 250 AS <S>))",
        "resp_p": "CAST(1 + l_partkey % 20 AS <S>)",
        "conn_state": "CASE l_returnflag WHEN 'R' THEN 'REJ' WHEN 'A' THEN 'S0' ELSE 'SF' END",
        "proto": "CASE WHEN l_linenumber % 2 = 0 THEN 'tcp' ELSE 'icmp' END",
        "resp_bytes": "CASE WHEN l_discount < 0.015 THEN '-'"
                      " ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS <S>) END",
        "duration": "CASE WHEN l_tax < 0.015 THEN '-'"
                    " ELSE CAST(CAST(l_quantity AS BIGINT) AS <S>) END",
    }),
    "zeek_notice": ("orders", {
        "uid": "o_orderkey",
        "orig_h": "concat('10.1.0.', CAST(o_custkey % 256 AS <S>))",
        "resp_h": "concat('10.2.0.', CAST(o_orderkey % 250 AS <S>))",
        "src": "CASE WHEN o_orderkey % 4 = 0 THEN '-' WHEN o_orderkey % 4 = 1 THEN"
               " concat('10.1.0.', CAST(o_custkey % 256 AS <S>)) ELSE '' END",
        "dst": "CASE WHEN o_orderkey % 6 = 0 THEN '10.9.9.9' ELSE '-' END",
        "note": "CASE o_custkey % 256 % 4 WHEN 0 THEN concat('Scan::Port_Scan ', o_orderpriority)"
                " WHEN 1 THEN 'HTTP::SQL_Injection_Attacker' WHEN 2 THEN '' ELSE 'Weird::Activity' END",
        "msg": "concat('seen ', o_orderstatus)",
    }),
    "zeek_weird": ("customer", {
        "uid": "c_custkey",
        "orig_h": "concat('10.1.0.', CAST((c_custkey * c_custkey) % 97 % 256 AS <S>))",
        "resp_h": "concat('10.2.0.', CAST(c_custkey % 250 AS <S>))",
        "src": "'-'",
        "dst": "CASE WHEN c_custkey % 3 = 0 THEN concat('10.2.0.', CAST(c_custkey % 7 AS <S>)) ELSE '' END",
        "name": "c_mktsegment",
    }),
    "abuse_feed": ("customer", {
        "indicator": "concat('100.128.0.', CAST(c_custkey % 256 AS <S>))",
        "abuse_score": "CAST(floor(c_acctbal / 100) AS <D>)",
    }),
    "meta_feed": ("supplier", {
        "indicator": "concat('100.128.0.', CAST(s_suppkey % 256 AS <S>))",
        "proxy": "s_suppkey % 3 = 0",
        "hosting": "s_suppkey % 4 <> 0",
    }),
    "vote_feed": ("part", {
        "indicator": "concat('h', CAST(p_partkey % 9 AS <S>), '.example.net:8080')",
        "malicious": "CAST(CASE WHEN p_partkey % 9 < 2 THEN p_partkey % 4 ELSE 0 END AS BIGINT)",
        "suspicious": "CAST(CASE WHEN p_partkey % 9 < 5 THEN p_partkey % 3 ELSE 0 END AS BIGINT)",
        "undetected": "CAST(p_partkey % 60 AS BIGINT)",
    }),
    "blocklist_lines": ("supplier", {
        "value": "CASE s_suppkey % 10"
                 " WHEN 0 THEN concat('  100.128.0.', CAST(s_suppkey * 4 % 256 AS <S>), '/30')"
                 " WHEN 1 THEN concat('100.', CAST(s_suppkey % 256 AS <S>), '.0.0/16  # range')"
                 " WHEN 2 THEN concat('100.128.0.', CAST(s_suppkey % 256 AS <S>), '  ')"
                 " WHEN 3 THEN '# comment'"
                 " WHEN 4 THEN ''"
                 " WHEN 5 THEN concat('77.', CAST(s_suppkey % 200 AS <S>), '.0.0/12#x')"
                 " ELSE concat('203.', CAST(s_suppkey % 256 AS <S>), '.7.0/24') END",
    }),
    # Signals of a scored record as R1-R9 take them; values step through all the cuts.
    "scored": ("lineitem", {
        "rec_id": "l_orderkey * 10 + l_linenumber",
        "rf_prob": "CAST((l_partkey * 37 % 1000) / 1000.0 AS <D>)",
        "strength": "CASE WHEN l_suppkey % 3 = 0 THEN CAST(0.0 AS <D>)"
                    " ELSE CAST((l_orderkey * 13 % 700) / 1000.0 AS <D>) END",
        "entropy": "CAST((l_partkey % 81) / 10.0 AS <D>)",
        "unusual_port": "CASE WHEN l_linenumber = 3 THEN CAST(2000 + l_suppkey % 9 AS INT) END",
        "pps": "CAST(l_extendedprice / 40 AS <D>)",
        "behavior": "CASE WHEN l_orderkey % 17 = 0 THEN 'flood' WHEN l_orderkey % 17 = 1 THEN 'port_scan'"
                    " WHEN l_orderkey % 17 = 2 THEN 'dns_tunnel' END",
        "n_dns": "CAST(l_orderkey % 23 % 6 AS INT)",
        "ip_verdict": "CASE l_suppkey % 9 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious'"
                      " WHEN 2 THEN 'safe' WHEN 3 THEN 'unknown' END",
        "ip_score": "CASE WHEN l_suppkey % 9 < 3 THEN CAST((l_partkey % 101) / 100.0 AS <D>) END",
        "url_verdict": "CASE l_partkey % 11 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'safe' END",
        "url_score": "CASE WHEN l_partkey % 11 = 0 THEN CAST(0.55 AS <D>) END",
        "zeek_score": "CAST(CASE WHEN l_linenumber % 4 = 0 THEN (l_partkey % 9) / 10.0 ELSE 0 END AS <D>)",
        "zeek_logs": "l_linenumber % 4 = 0",
    }),
}


def _fill(text: str, words: dict[str, str]) -> str:
    for key, value in words.items():
        text = text.replace(f"<{key}>", value)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, in the pieces the reader's split size gives."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame."""
    source, columns = _COLUMNS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[f"{_fill(e, _SPARK)} AS {c}" for c, e in columns.items()]
    )


def sql(name: str) -> str:
    """The same adapter as one common table expression."""
    source, columns = _COLUMNS[name]
    body = ", ".join(f"{_fill(e, _DUCK)} AS {c}" for c, e in columns.items())
    return f"{name} AS (SELECT {body} FROM {source})"


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(sql(n) for n in names)
