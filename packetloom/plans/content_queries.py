"""Registered queries: requests and signature scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.signatures import category_patterns
from packetloom.operators import content
from packetloom.plans.adapters import adapt, table
from packetloom.plans.registry import query


def _found(col: str, prefix: str = "") -> str:
    """SQL for the sorted categories; DuckDB's engine needs (?i) and no flags for '.'."""
    tests = []
    for category, patterns in category_patterns().items():
        pattern = "|".join(patterns)
        name = prefix + (category.lower() if prefix else category)
        quoted = pattern.replace("'", "''")
        tests.append(f"CASE WHEN regexp_matches({col}, '(?i){quoted}') THEN '{name}' END")
    return "concat_ws(',', " + ", ".join(tests) + ")"


@query("c5_signatures_payloads", ("payloads",), f"SELECT payload_id, {_found('payload')} AS findings FROM payloads")
def c5_signatures_payloads(spark, sf_dir):
    return content.scan(adapt(spark, sf_dir, "payloads"), "payload", decode=False).select(
        "payload_id", F.array_join("findings", ",").alias("findings")
    )


@query("c5_signatures_pages", (), f"SELECT page_id, {_found('html')} AS findings FROM pages")
def c5_signatures_pages(spark, sf_dir):
    return content.scan(table(spark, sf_dir, "pages"), "html", decode=False).select(
        "page_id", F.array_join("findings", ",").alias("findings")
    )


@query("c5_signatures_conversations", (), f"SELECT conv_id, turn, {_found('text')} AS findings FROM conversations")
def c5_signatures_conversations(spark, sf_dir):
    return content.scan(table(spark, sf_dir, "conversations"), "text", decode=False).select(
        "conv_id", "turn", F.array_join("findings", ",").alias("findings")
    )


def _union(*found: str) -> str:
    """Categories that any of the texts has, sorted."""
    lists = ", ".join(f"string_split({f}, ',')" for f in found)
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten([{lists}]), lambda x: x <> ''))), ',')"


# The only hidden text inside a payload, and how form encoding writes a blank.
_PLAIN = "replace(payload, '%2e%2e%2fetc', '../etc')"


@query("c4_variant_scan", ("payloads",), f"""
, h AS (SELECT payload_id, CASE WHEN payload_id % 3 = 1 THEN replace(payload, ' ', '+') ELSE payload END AS payload FROM payloads),
s AS (SELECT payload_id, CASE payload_id % 3 WHEN 0 THEN base64(encode(payload))
  WHEN 1 THEN replace(replace(replace(url_encode(payload), '%20', '+'), '%2A', '*'), '~', '%7E') ELSE payload END AS hidden FROM payloads),
p AS (SELECT h.payload_id, payload, {_PLAIN} AS plain, hidden FROM h JOIN s ON s.payload_id = h.payload_id)
SELECT payload_id, {_union(_found('payload'), _found('plain'), _found('hidden'))} AS findings FROM p
""")
def c4_variant_scan(spark, sf_dir):
    payloads = adapt(spark, sf_dir, "payloads")
    hidden = F.when(
        F.col("payload_id") % 3 == 0, F.base64(F.encode("payload", "UTF-8"))
    ).when(F.col("payload_id") % 3 == 1, F.url_encode("payload")).otherwise(F.col("payload"))
    return content.scan(payloads.withColumn("payload", hidden), "payload").select(
        "payload_id", F.array_join("findings", ",").alias("findings")
    )


_REQUEST = (
    "CASE WHEN page_id % 8 = 3 THEN concat('POST /plain/', page_id, ' ', html) WHEN page_id % 4 = 3 THEN html ELSE concat(CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END,"
    " ' /item/', page_id, '?q=a%20b&n=', page_id % 7, '&n=x&e=#f HTTP/1.1', chr(13), chr(10), 'Host: first', chr(13), chr(10),"
    " 'HOST: h', page_id % 9, '.example.net', chr(13), chr(10), 'Via: x', chr(13), chr(10), chr(13), chr(10), url) END"
)


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url AS page_url", f"{_REQUEST} AS payload"
    )


@query("c1_http_requests", (), """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' END AS method,
  CASE WHEN page_id % 4 < 3 THEN concat('h', page_id % 9, '.example.net') END AS host,
  CASE WHEN page_id % 4 < 3 THEN concat('http://h', page_id % 9, '.example.net/item/', page_id, '?q=a%20b&n=', page_id % 7, '&n=x&e=#f') END AS url,
  CASE WHEN page_id % 4 < 3 THEN 'x' END AS via, CASE WHEN page_id % 4 < 3 THEN 'a b' END AS q,
  CASE WHEN page_id % 4 < 3 THEN concat(page_id % 7, ',x') END AS n,
  CASE WHEN page_id % 4 < 3 THEN url END AS body FROM pages
""")
def c1_http_requests(spark, sf_dir):
    return content.http_requests(_requests(spark, sf_dir)).select(
        "page_id", "http.method", "http.host", "http.url", F.col("http.headers")["via"].alias("via"),
        F.col("http.query")["q"][0].alias("q"), F.array_join(F.col("http.query")["n"], ",").alias("n"),
        "http.body",
    )


@query("c2_assemble_url", (), """
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN concat('http://h', page_id % 9, '.example.net/item/', page_id, '?q=a%20b&n=', page_id % 7, '&n=x&e=#f')
  WHEN page_id % 8 = 3 THEN concat('/plain/', page_id)
  ELSE nullif(regexp_extract(html, '(?:GET|POST)\\s+([^\\s]+)', 1), '') END AS url FROM pages
""")
def c2_assemble_url(spark, sf_dir):
    return content.assemble_url(content.http_requests(_requests(spark, sf_dir))).select("page_id", "url")


@query("c6_content_gate", ("payloads",), f"""
, b AS (SELECT payload_id, concat_ws(' ', CASE WHEN payload_id % 4 < 2 THEN 'short' ELSE payload END) AS blob FROM payloads)
SELECT payload_id, CASE WHEN length(blob) >= 24 OR contains(blob, '=') OR contains(blob, '?') OR (contains(blob, '/') AND length(blob) > 12)
  THEN {_found('blob', 'http_')} ELSE '' END AS content_reasons FROM b
""")
def c6_content_gate(spark, sf_dir):
    """The texts as they are; c6_content_reasons also looks at their decoded forms."""
    return content.content_reasons(_previews(spark, sf_dir), decode=False).select(
        "payload_id", F.array_join("content_reasons", ",").alias("content_reasons")
    )


def _previews(spark, sf_dir):
    return adapt(spark, sf_dir, "payloads").select(
        "payload_id", F.lit("").alias("url"),
        F.when(F.col("payload_id") % 4 < 2, "short").otherwise(F.col("payload")).alias("payload_preview"),
    )


@query("c6_content_reasons", ("payloads",), f"""
, b AS (SELECT payload_id, CASE WHEN payload_id % 4 < 2 THEN 'short' ELSE payload END AS payload FROM payloads),
p AS (SELECT payload_id, payload, {_PLAIN} AS plain FROM b)
SELECT payload_id, CASE WHEN length(payload) >= 24 OR contains(payload, '=') OR contains(payload, '?') OR (contains(payload, '/') AND length(payload) > 12)
  THEN {_union(_found('payload', 'http_'), _found('plain', 'http_'))} ELSE '' END AS content_reasons FROM p
""")
def c6_content_reasons(spark, sf_dir):
    """Reasons in their own order, in which scanning comes before sqli."""
    return content.content_reasons(_previews(spark, sf_dir)).select(
        "payload_id", F.array_join(F.array_sort("content_reasons"), ",").alias("content_reasons")
    )
