"""Rules at their boundaries, on rows written by hand."""

import base64
import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom import session
from packetloom.functions import net, risk, signatures, text, times
from packetloom.functions.signatures import finder, plan_tests
from packetloom.operators import content, intel, ml, scoring, zeek
from packetloom.operators.isolation import fit_isolation
from packetloom.sources import lists, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


@pytest.mark.parametrize("value, want", [
    (0.78, "dangerous"), (0.78 - 1e-9, "suspicious"), (0.52, "suspicious"), (0.52 - 1e-9, "safe"),
])
def test_class_cuts(spark, value, want):
    none = F.lit(None).cast("string")
    made = risk.classify(F.lit(value), F.lit("safe"), F.array().cast("array<string>"), none, F.lit(0), F.lit(False))
    assert one(spark, made)[0] == want


LADDER = [
    (0.40, "safe", ["reputation_ip_malicious"], None, 0, False, "suspicious"),
    (0.40, "safe", ["reputation_url_malicious"], None, 0, False, "suspicious"),
    (0.10, "safe", ["reputation_ip_suspicious"], None, 0, False, "suspicious"),
    (0.30, "safe", [], "flood", 0, True, "suspicious"),
    (0.30, "safe", [], "port_scan", 0, True, "suspicious"),
    (0.48, "safe", [], None, 1, True, "suspicious"),
    (0.47, "safe", [], None, 1, True, "safe"),
    (0.45, "safe", ["ml_attack"], None, 0, True, "suspicious"),
    (0.10, "safe", ["http_sqli"], None, 0, True, "suspicious"),
    (0.10, "safe", ["http_sqli"], None, 0, False, "safe"),
    (0.50, "safe", [], None, 0, True, "suspicious"),
    (0.42, "suspicious", [], None, 0, False, "suspicious"),
    (0.41, "suspicious", [], None, 0, False, "safe"),
    (0.51, "dangerous", [], None, 0, False, "safe"),
]


def test_ladder(spark):
    rows = [(i, *r) for i, r in enumerate(LADDER)]
    df = spark.createDataFrame(rows, "i int, risk double, label string, reasons array<string>, behavior string,"
                               " rf int, attack boolean, want string")
    made = risk.classify(*[F.col(c) for c in ("risk", "label", "reasons", "behavior", "rf", "attack")])
    assert all(r.got == r.want for r in df.withColumn("got", made).collect())


def test_missing_score_counts_by_verdict(spark):
    none = F.lit(None).cast("double")
    made = [risk.source_score(F.lit(True), F.lit(v), none) for v in ("malicious", "suspicious", "safe", "unknown")]
    assert list(one(spark, *made)) == [0.85, 0.45, 0.0, 0.08]
    assert one(spark, risk.source_score(F.lit(False), F.lit("malicious"), none))[0] == 0.0


def test_untrusted_models(spark):
    df = spark.range(1).select(
        F.lit(0.9).alias("rf_prob"), F.lit(1).alias("rf_pred"), F.lit(1).alias("iso_pred"), F.lit(0.0).alias("iso_raw"),
        F.lit(None).cast("string").alias("behavior"))
    row = scoring.score_records(df, has_iso=False, trusted=False).head()
    assert row.ml_score == 0.9 and row.ai_score == pytest.approx(0.9 * 0.92)
    assert row.reasons[-1] == "ml_model_untrusted" and row.explanation.thresholds.dangerous == 0.78


def test_reason_order_and_repeats(spark):
    df = spark.range(1).select(
        F.lit(0.7).alias("rf_prob"), F.lit(1).alias("rf_pred"), F.lit(-1).alias("iso_pred"), F.lit(-1.0).alias("iso_raw"),
        F.lit("flood").alias("behavior"), F.lit(8.0).alias("payload_entropy"), F.lit(4444).alias("unusual_port"),
        F.lit(600.0).alias("flow_packets_per_s"), F.array(F.lit("http_xss")).alias("content_reasons"),
        F.array(F.lit("dns_txt_query"), F.lit("flood")).alias("dns_reasons"),
        F.struct(F.lit("malicious").alias("verdict"), F.lit(1.0).alias("score")).alias("ti_ip"),
        F.array(F.lit("reputation_ip_malicious"), F.lit("flood")).alias("intel_reasons"))
    row = scoring.score_records(df).head()
    assert row.reasons == [
        "high_rf_attack_probability", "strong_anomaly_detected", "combined_ml_signals", "high_payload_entropy",
        "unusual_port_4444", "traffic_burst", "http_xss", "flood", "dns_txt_query", "ml_attack", "anomaly",
        "reputation_ip_malicious"]
    assert row.classification == "dangerous" and row.explanation.fused_risk == round(row.risk_score, 4)


# ---- content --------------------------------------------------------------------------


def test_decoded_forms(spark):
    import html

    hidden = [
        ("%2527", "'"), ("&lt;script&gt;", "<script>"), (r"\x3cscript\u003e", "<script>"), ("&amp;lt;b", "<b"), ("100%25 & +", "100% & +"),
        (base64.b64encode(b"<script>alert(1)").decode(), "<script>alert(1)"), ("&#60;&#x3E;&eacute;&nbsp;", "<>\u00e9\u00a0"),
        (r"\ud83d\ude00", "\U0001f600"), (r"a\ud800b", "a\ufffdb"), (r"\ude00\ud83d", "\ufffd\ufffd"), ("&#xD800;&#0;", "\ufffd\ufffd"),
        (r"\101\n\"", 'A\n"'), (r"\U0001f600", "\U0001f600"), ("%", "%"), ("plain text", "plain text"), ("", ""),
    ]
    deep = "<script>"
    for _ in range(9):
        deep = base64.b64encode(deep.encode()).decode()
    hidden.append((deep, "<script>"))
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(hidden)] + [(99, None)], "i int, p string")
    got = {r.i: r.f for r in df.select("i", content.payload_variants(F.col("p")).alias("f")).collect()}
    for i, (raw, want) in enumerate(hidden):
        assert got[i][0] == raw and want in got[i], (raw, got[i])
    assert got[14] == ["plain text"] and got[15] == [""] and got[99] == [None]
    assert html.unescape(hidden[6][0]) in got[6]


def test_variants_of_a_table(spark):
    """Passes over a table reach what the fold reaches, however deep a text is hidden."""
    deep = "%" + "25" * 70 + "3Cscript%" + "25" * 9 + "3E"
    texts = ["plain", None, "", deep, "&amp;" * 3 + "lt;x", "%41" * 2000, base64.b64encode(("<b>" * 9000).encode()).decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string").withColumn("_key", F.lit("kept"))
    got = {r.i: r for r in content.with_variants(df, "p").collect()}
    folds = df.where("length(p) < 2000 OR p IS NULL").select("i", content.payload_variants(F.col("p")).alias("f"))
    assert {r.i: sorted(got[r.i]._forms, key=str) for r in folds.collect()} == {r.i: sorted(r.f, key=str) for r in folds.collect()}
    assert len(got) == len(texts) and {r._key for r in got.values()} == {"kept"}
    assert "<script>" in got[3]._forms and len(got[3]._forms) == 72
    assert "A" * 2000 in got[5]._forms and "<b>" * 9000 in got[6]._forms
    empty = content.with_variants(df.where("i > 99"), "p")
    assert empty.columns == ["i", "p", "_key", "_forms"] and empty.count() == 0


def test_literals_found_as_by_substring_tests():
    literals, _ = plan_tests()
    find = finder(literals)
    rng = random.Random(3)
    words = [*literals, " ", "x", "or ", "aa"]
    for _ in range(300):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(12)))
        want = 0
        for literal, bits in literals.items():
            want |= bits if literal in text else 0
        assert find(text) == want


def test_hidden_signatures(spark):
    hidden = [
        "%3Cscript%3E", "&lt;script&gt;", r"\x3cscript\x3e", base64.b64encode(b"id=1 union select a").decode(),
        base64.b64encode(b"%3Cscript%3E  ").decode(), "nothing here", "\u00e9t\u00e9 \\ back", None,
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hidden)], "i int, p string")
    got = {r.i: r.findings for r in content.scan(df, "p").collect()}
    assert [got[i] for i in range(3)] == [["XSS"]] * 3
    assert got[3] == ["SQLi"] and got[4] == ["XSS"] and got[5] == got[6] == got[7] == []


def test_words_are_not_unpacked(spark):
    """Letters and blanks are letters of base64 too; as bytes they are no text, and their rest held a '#'."""
    words = "Nmrni Ktacp Fnfsr Yrufin Jlxom Mjhlss"
    texts = [words, base64.b64encode(words.encode()).decode(), base64.b64encode("é #".encode() * 9).decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    forms = {r.i: r._forms for r in content.with_variants(df, "p").collect()}
    assert forms[0] == [words] and forms[1] == [texts[1], words] and "é #" * 9 in forms[2]
    got = {r.i: r.findings for r in content.scan(df, "p").collect()}
    assert got == {0: [], 1: [], 2: ["SQLi"]}


def test_each_pattern_alone(spark):
    """Substring tests and guards find what the bare regular expression finds."""
    import re

    samples = [
        "UNION  SELECT", "select a from b", "x or 1=1", "/* c */", "' or '", "or 'a'='b'", "A" * 100, "a" * 99, "aaa",
        "\u00ec", "\u00cc", "\0\0", "\x90" * 3, "<IMG x src=", "; \t ls", ";\u00a0cat", "bearer abc", "/bootXini", "nc -e",
        "\u017fegfault", "\u212aeychain nmap", "N\u0130KTO", "n\u0131kto", "select\nfrom", "<script\n>", "`a`", "`\n`", "$(", "||",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = {r.t: r.findings for r in content.scan(df, "t", decode=False).collect()}
    for s in samples:
        want = [c for c, ps in signatures.category_patterns().items() if any(re.search(p, s, re.I) for p in ps)]
        assert got[s] == want, s
    assert sum(len(p) for p in signatures.SIGNATURES.values()) == 129


def test_disabled_patterns(spark):
    df = spark.createDataFrame([("a # b",)], "t string")
    assert content.scan(df, "t", decode=False, disabled=["#"]).head().findings == []


def test_http_request(spark):
    raw = b"POST /a?x=1&x=2&y=%41+b&z= HTTP/1.1\r\nHost: One\r\nhost: two\r\nX-Y:  v\xff\r\n\r\n" + b"b" * 600
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"GET-ish")), (3, None)], "i int, payload binary")
    rows = {r.i: r.http for r in content.http_requests(df).collect()}
    got = rows[1]
    assert (got.method, got.host, got.path) == ("POST", "two", "/a?x=1&x=2&y=%41+b&z=")
    assert got.url == "http://two/a?x=1&x=2&y=%41+b&z=" and got.query == {"x": ["1", "2"], "y": ["A b"]}
    assert got.headers["x-y"] == "v" and got.body == "b" * 600
    first = content.http_requests(df, body_bytes=500).where("i = 1").head().http
    assert first.body == "b" * 500
    assert rows[2] is None and rows[3] is None


@pytest.mark.parametrize("blob, want", [
    ("short alert(", []), ("alert( long enough to count", ["http_xss"]), ("alert(?", ["http_xss"]), ("a/b alert(12)", ["http_xss"]),
    ("   ", []),
])
def test_content_gate(spark, blob, want):
    df = spark.createDataFrame([(blob,)], "payload_preview string")
    assert content.content_reasons(df).head().content_reasons == want


# ---- text, time and address helpers ---------------------------------------------------


def test_reasons_and_objects(spark):
    raw = [None, "", "[]", '["a", null, 1]', '"x"', "null", "{bad", "7"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    got = [r[0] for r in df.select(text.decode_reasons(F.col("r"))).collect()]
    assert got == [[], [], [], ["a", "1"], ["x"], [], ["_reasons_json_parse_error"], ["7"]]
    got = [r[0] for r in df.select(text.decode_object(F.col("r"))).collect()]
    assert got[:2] == [None, None] and got[4] == '{"value":"x"}' and got[5] == '{"value":null}'
    assert got[6] == '{"_parse_error":true,"_raw":"{bad"}'


def test_event_times(spark):
    made = times.event_time(F.lit("inf"), F.lit(-1), F.lit("1700000000500"), now=F.lit(5))
    assert one(spark, made)[0] == pytest.approx(1700000000.5)
    assert one(spark, times.event_time(F.lit(None), now=F.lit(5)))[0] == 5.0
    assert one(spark, times.millis(F.lit(0.0025)))[0] == 2  # half to even


def test_domains(spark):
    names = {"A.b.C.": "b.c", "x": "x", "..": "", "a..b.c": "b.c"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.d for r in df.withColumn("d", text.base_domain(F.col("n"))).collect()} == names
    urls = {"http://U@H.tk:8/x": "u@h.tk:8", "h.com/p": "h.com", "mailto:x": "mailto:x", "http:///p": "/p"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.d for r in df.withColumn("d", text.url_domain(F.col("u"))).collect()} == urls


def test_addresses(spark):
    want = {
        "10.1.2.3": True, "172.32.0.1": False, "192.0.0.9": False, "192.0.0.8": True, "100.64.0.1": False, "::1": True,
        "fe80::1": True, "2001:db8::1": True, "2606:4700::1": False, "300.1.1.1": False, "x": False, " 127.0.0.1 ": True,
    }
    df = spark.createDataFrame([(a,) for a in want], "a string")
    assert {r.a: r.p for r in df.withColumn("p", net.is_private(F.col("a"))).collect()} == want


def test_blocklist(spark):
    lines = spark.createDataFrame([(v,) for v in ("# c", "", " 1.2.3.4 # x", "5.6.7.9/24#y", "2001:db8::1", "9.9.9.9/0x")], "value string")
    block = lists.parse_blocklist(lines)
    ips = spark.createDataFrame([(a,) for a in ("1.2.3.4", "1.2.3.5", "5.6.7.200", "5.6.8.1", "2001:db8::1", "bad", None)], "src_ip string")
    got = {r.src_ip: r.listed for r in intel.match_blocklist(ips, block).collect()}
    assert [a for a, hit in got.items() if hit] and {a for a, hit in got.items() if hit} == {"1.2.3.4", "5.6.7.200", "2001:db8::1"}
    exact = {r.src_ip for r in intel.match_blocklist(ips, block, exact=True).collect() if r.listed}
    assert exact == {"1.2.3.4", "2001:db8::1"}


def test_safe_never_wins_a_merge(spark):
    df = spark.createDataFrame([("i", "p", "safe", 0.0), ("j", "p", "safe", 0.0), ("j", "q", "suspicious", 0.3)],
                               "indicator string, provider string, verdict string, score double")
    got = {r.indicator: (r.verdict, r.score) for r in intel.merge_providers(df).collect()}
    assert got == {"i": ("unknown", None), "j": ("suspicious", 0.3)}


def test_enrichment_gates(spark):
    df = spark.createDataFrame(
        [(1, "9.9.9.9", 0.1, None, None), (2, "9.9.9.9", 0.3, None, None), (3, "10.0.0.1", 0.3, None, None), (4, "8.8.8.8", 0.0, None, None),
         (5, "7.7.7.7", 0.0, "flood", None), (6, "7.7.7.7", 0.5, None, "http://login1.tk/")],
        "id int, src_ip string, adjusted_score double, behavior string, url string")
    block = spark.createDataFrame([("8.8.0.0/16",)], "value string")
    abuse = spark.createDataFrame([("9.9.9.9", 80.0)], "indicator string, abuse_score double")
    rows = {r.id: r for r in intel.enrich(df, block, abuse).collect()}
    assert rows[1].ti_ip is None and rows[1].intel_reasons == []
    assert rows[2].ti_ip.verdict == "malicious" and rows[2].intel_reasons == ["reputation_ip_malicious"]
    assert rows[3].ti_ip.verdict == "safe" and rows[3].intel_reasons == ["reputation_ip_safe"]
    assert rows[4].intel_reasons == ["reputation_ip_malicious"] and rows[4].ti_ip.score == 1.0
    assert rows[5].ti_ip.verdict == "unknown" and rows[5].intel_reasons == []
    assert rows[6].ti_url.verdict == "suspicious" and rows[6].ti_url.score == 0.55
    busy = {r.id: r for r in intel.enrich(df, block, abuse, pressure=0.8).collect()}
    assert busy[2].ti_ip is None and busy[4].intel_reasons == ["reputation_ip_malicious"]
    now = F.timestamp_seconds(F.lit(100))
    cache = spark.createDataFrame([("9.9.9.9", "ip", "safe", 0.0, 200), ("7.7.7.7", "ip", "malicious", 0.9, 50)],
                                  "lookup_key string, lookup_type string, verdict string, score double, e long")
    cache = cache.withColumn("expires_at", F.timestamp_seconds("e"))
    held = {r.id: r for r in intel.enrich(df, block, abuse, cache=cache, cache_as_of_time=now).collect()}
    assert held[2].ti_ip.verdict == "safe" and held[5].ti_ip.verdict == "unknown"


def test_newest_per_key_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    got = sorted((r.k, r.o) for r in zeek.newest_per_key(df, "k", "o", 7).collect())
    assert got == sorted((o % 3, o) for k in range(3) for o in [x for x in range(1000) if x % 3 == k][-7:])


# ---- models ---------------------------------------------------------------------------


def test_hybrid_weights(spark):
    cases = {(0.9, 0.5): 0.9 * 0.78 + 0.5 * 0.22, (0.1, 0.6): 0.1 * 0.3 + 0.4 * 0.7, (0.3, 0.6): 0.3 * 0.42 + 0.6 * 0.58, (0.6, 0.2): 0.6 * 0.58 + 0.2 * 0.42}
    df = spark.createDataFrame(list(cases), "rf double, s double")
    for r in df.withColumn("m", risk.hybrid_score(F.col("rf"), F.col("s"))).collect():
        assert r.m == pytest.approx(cases[(r.rf, r.s)])


def test_auc_with_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.5), (1, 0.2)]
    wins = sum((p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z)
    df = spark.createDataFrame(rows, "label int, score double")
    assert ml.roc_auc(df).head()[0] == pytest.approx(wins / 9)
    assert ml.roc_auc(df.where("label = 1")).head()[0] is None


def _clusters(spark, n=600):
    """Two separable classes of 18 features; class 1 is shifted."""
    cells = [(F.randn(i) + F.when(F.col("id") % 4 == 0, 3.0).otherwise(0.0)) for i in range(18)]
    return spark.range(n).select("id", F.array(*cells).alias("features"), (F.col("id") % 4 == 0).cast("int").alias("label")).cache()


def test_isolation_finds_outliers(spark):
    normal = spark.range(500).select("id", F.array(F.randn(1), F.randn(2)).alias("features"))
    model = fit_isolation(normal, "id", trees=60, contamination=0.05)
    far = spark.createDataFrame([(1, [9.0, -9.0]), (2, [0.0, 0.0])], "id long, features array<double>")
    got = {r.id: r.iso_pred for r in model.transform(far).collect()}
    assert got == {1: -1, 2: 1}
    flagged = model.transform(normal).where("iso_pred = -1").count()
    assert 10 <= flagged <= 40
    assert fit_isolation(normal.limit(20), "id") is None


def test_retrain_extend_save_load(spark, tmp_path):
    rows = _clusters(spark)
    models, result = ml.retrain(rows, "id", trees=15, depth=8, isolation_trees=20)
    first = result.head()
    assert first.roc_auc > 0.9 and first.samples == 600 and first.test_rows == 120 and not first.incremental
    more, result = ml.retrain(rows, "id", models, extra_trees=5, depth=8, isolation_trees=20)
    assert result.head().incremental and [f.getNumTrees for f in more.forests] == [15, 5]
    ml.save(models, spark, str(tmp_path / "m"), 1.0)
    ml.save(more, spark, str(tmp_path / "m"), 2.0)
    loaded = ml.load(spark, str(tmp_path / "m"))
    assert loaded.trusted and [f.getNumTrees for f in loaded.forests] == [15, 5]
    a = more.predict(rows).orderBy("id").select("rf_prob", "iso_raw").collect()
    b = loaded.predict(rows).orderBy("id").select("rf_prob", "iso_raw").collect()
    assert all(math.isclose(x.rf_prob, y.rf_prob) and math.isclose(x.iso_raw, y.iso_raw) for x, y in zip(a, b))
    assert ml.retrain(rows.limit(50), "id") is None
    single, _ = ml.retrain(rows.where("label = 0"), "id", isolation_trees=10)
    assert not single.trusted and single.predict(rows.limit(1)).head().rf_prob == 0.0


class FixedModels:
    """Stands in for trained models: the attack probability is that of a big packet."""

    has_iso = trusted = True

    def predict(self, df):
        big = F.col("features")[4] > 1000
        return df.withColumns({
            "rf_prob": F.when(big, 0.9).otherwise(0.1), "rf_pred": big.cast("int"),
            "iso_pred": F.lit(1), "iso_raw": F.lit(0.1)})


def test_score_packets(spark):
    start = 10**15
    rows = [(i, start + i * 1000, "9.9.9.9", "1.1.1.1", 5, 1 + i, "TCP", "S", 60, None) for i in range(20)]
    rows.append((20, start + 10**8, "8.8.8.8", "1.1.1.1", 5, 4444, "TCP", "PA", 1400, bytearray(b"GET /?q=<script> HTTP/1.1\r\nHost: h\r\n\r\n")))
    packets = spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int,"
                                    " protocol string, tcp_flags string, bytes long, payload binary")
    abuse = spark.createDataFrame([("9.9.9.9", 90.0)], "indicator string, abuse_score double")
    dns = spark.createDataFrame([(20, ["dns_txt_query"])], "packet_id long, dns_reasons array<string>")
    got = {r.packet_id: r for r in scoring.score_packets(packets, FixedModels(), {"abuse": abuse}, dns=dns).collect()}
    assert len(got) == 21
    assert [got[i].behavior for i in (13, 14, 19)] == [None, "port_scan", "port_scan"]
    assert got[19].ti_ip.verdict == "malicious" and got[19].classification == "dangerous"
    last = got[20]
    assert last.url == "http://h/?q=<script>" and last.unusual_port == 4444
    assert last.reasons == ["high_rf_attack_probability", "unusual_port_4444", "traffic_burst", "http_xss", "dns_txt_query", "ml_attack"]
    assert last.explanation.attack_signals and last.adjusted_score > last.ml_score


def test_scored_packets_feed_the_sinks(spark, tmp_path):
    """Packets through score_packets() and verdict_rows() into the three sinks and back."""
    start = 1_704_067_200 * 10**6
    rows = [(i, start + i * 3600 * 10**6, "9.9.9.9", "1.1.1.1", 5, 80, "TCP", "S", 60 if i % 2 else 1400) for i in range(30)]
    packets = spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int,"
                                    " protocol string, tcp_flags string, bytes long")
    scored = scoring.score_packets(packets, FixedModels())
    path = str(tmp_path / "scored")
    scored.write.parquet(path)
    scored = spark.read.parquet(path)
    verdicts = tables.verdict_rows(scored)
    places = [str(tmp_path / name) for name in ("packet_logs", "ai_history", "training_data")]
    tables.write_dated(tables.log_rows(verdicts), places[0])
    tables.write_dated(tables.history_rows(verdicts), places[1])
    tables.training_rows(verdicts, 1.0).write.parquet(places[2])
    logs, history, taught = (spark.read.parquet(place) for place in places)
    want = {r.packet_id: r for r in scored.collect()}
    got = {r.id: r for r in logs.collect()}
    assert set(got) == set(want) == {r.id for r in history.collect()} and logs.count() == history.count() == 30
    for i, r in got.items():
        assert r.ts_sec == want[i].ts_us / 1e6 and str(r.event_date) == f"2024-01-0{1 + i // 24}"
        assert (r.classification, r.risk_score, r.anomaly_score) == (want[i].classification, want[i].risk_score, want[i].anomaly_strength)
    assert {r.id: r.features for r in history.collect()} == {i: r.features for i, r in want.items()}
    assert sorted((r.created_at, r.label) for r in taught.collect()) == sorted((r.ts_us / 1e6, r.classification) for r in want.values())


def test_reasons_of_c6_in_their_own_order(spark, tmp_path):
    """http_scanning comes before http_sqli, as the SQL sorts them, though SQLi comes before Scanning."""
    from packetloom.plans import registry

    registry.load()
    spark.createDataFrame([(10, "nmap and union select a, masscan")], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = registry.QUERIES["c6_content_reasons"](spark, str(tmp_path)).collect()
    assert [r.content_reasons for r in got] == ["http_scanning,http_sqli"]


def test_preview_reads_its_rows_once(spark, tmp_path):
    made = [("attack", [1.0] * 3, False)] * 3 + [("benign", None, True), ("benign", [1.0] * 3, False), ("odd", None, True)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(made, "label string, features array<double>, skipped boolean").write.parquet(path)
    seen = ml.preview(spark.read.parquet(path), dim=3, min_samples=4)
    want = [("attack", 3, 3, 2, True), ("benign", 1, 3, 2, True)]
    assert sorted(tuple(r) for r in seen.select("label", "samples", "feature_dim", "skipped_rows", "ready").collect()) == want
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert not ml.preview(spark.read.parquet(path), dim=3, min_samples=5).head().ready
    assert ml.preview(spark.read.parquet(path).where("skipped"), dim=3).collect() == []


def test_entropy_of_large_payloads_in_small_batches(spark):
    """Batches are bounded in bytes, pieces of a payload are counted together."""
    session.configure(spark)
    rows = spark.range(60, numPartitions=1).select(F.expr("repeat(char(65 + id % 3), 1500000)").cast("binary").alias("p"))

    @F.pandas_udf("long")
    def together(part):
        return part.map(len) * 0 + int(part.map(len).sum())

    assert rows.select(together("p").alias("n")).agg(F.max("n")).head()[0] <= 20_000_000
    mixed = spark.sql("SELECT cast(concat(repeat('a', 1500000), repeat('b', 1500000)) AS binary) AS p UNION ALL SELECT cast('' AS binary)")
    assert sorted(r.e for r in mixed.select(text.byte_entropy("p").alias("e")).collect()) == [0.0, 1.0]


def test_isolation_samples_rows_that_a_split_left(spark):
    """Few of many rows are sampled; a split by a hash of the same ids must not have taken just these."""
    rows = spark.range(3000).selectExpr("id", "0 AS label", "array(cast(id % 17 AS double), cast(id % 5 AS double)) AS features")
    train = ml.split(rows, "id").where("NOT is_test")
    model = fit_isolation(train, "id", trees=20, tree_rows=8)
    assert model.nodes["tree"].nunique() == 20
    assert model.offset < 0
