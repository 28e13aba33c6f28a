"""Windowed rules against plain loops, on dense random data and the default windows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.functions import text
from packetloom.operators import alerts, behavior, dns, flows, intel, maintain, prefix
from packetloom.operators.prefix import attach

S = 1_000_000


def traffic(seed, n=4000):
    """Four phases per source: quiet, scan, flood on few ports, flood over many ports."""
    rng = random.Random(seed)
    rows, now = [], 1_700_000_000 * S
    for i in range(n):
        phase = (i // 400) % 4
        now += rng.randint(1, (900_000, 400_000, 9_000, 12_000)[phase])
        port = rng.randint(1, (5, 60, 4, 40)[phase])
        src = "a" if rng.random() < 0.8 else rng.choice("bc")
        rows.append((i, now, src, None if rng.random() < 0.05 else port))
    return rows


@pytest.fixture(scope="module")
def packets(spark):
    rows = traffic(1)
    return rows, spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, dst_port int").cache()


def newest_first(rows, i):
    """The row itself and earlier ones of its source, newest first."""
    return (rows[j] for j in range(i, -1, -1) if rows[j][2] == rows[i][2])


def verdict(rows, i, flood_n=120, flood_us=3 * S, scan_n=15, scan_us=8 * S, history=None):
    count, ports = 0, set()
    for seen, (_, ts, _, port) in enumerate(newest_first(rows, i)):
        age = rows[i][1] - ts
        if age > max(flood_us, scan_us) or (history and seen >= history):
            return None
        if age <= flood_us:
            count += 1
            if count > flood_n:
                return "flood"
        if age <= scan_us and port is not None:
            ports.add(port)
            if len(ports) >= scan_n:
                return "port_scan"
    return None


@pytest.mark.parametrize("chunk", [60 * S, S // 2])
def test_precedence(packets, chunk):
    rows, df = packets
    want = {r[0]: verdict(rows, i) for i, r in enumerate(rows)}
    assert set(want.values()) == {None, "flood", "port_scan"}
    got = {r.packet_id: r.behavior for r in behavior.detect(df, chunk=chunk, row_chunk=150).collect()}
    assert got == want


def test_history_cap(packets):
    rows, df = packets
    want = {r[0]: verdict(rows, i, history=20) for i, r in enumerate(rows)}
    got = {r.packet_id: r.behavior for r in behavior.detect(df, history=20, row_chunk=100).collect()}
    assert got == want


def test_recent_counts_and_distinct(packets):
    rows, df = packets
    both = behavior.recent_distinct(behavior.recent_counts(df, 3 * S), "dst_port", 8 * S)
    got = {r.packet_id: (r.recent, r.distinct_recent) for r in both.collect()}
    for i, row in enumerate(rows):
        near = [(row[1] - ts, port) for _, ts, _, port in newest_first(rows, i)]
        count = sum(age <= 3 * S for age, _ in near)
        ports = len({p for age, p in near if age <= 8 * S and p is not None})
        assert got[row[0]] == (count, ports)


def test_ties_see_each_other(spark):
    df = spark.createDataFrame([(1, 5, "a", 1), (2, 5, "a", 2), (3, 9, "a", 1)],
                               "packet_id long, ts_us long, src_ip string, dst_port int")
    got = {r.packet_id: r.recent for r in behavior.recent_counts(df, 4).collect()}
    assert got == {1: 2, 2: 2, 3: 3}
    got = {r.packet_id: r.recent for r in behavior.recent_counts(df, 3).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_attach_takes_totals_from_base(packets):
    rows, df = packets
    one = F.lit(1).cast("long")
    got = attach(df.withColumn("x", F.lit(1)), ["src_ip"], "ts_us", sums={"n": one}, tiebreak="packet_id",
                 chunk=S, base=df)
    seen = defaultdict(int)
    for row in got.orderBy("packet_id").collect():
        seen[row.src_ip] += 1
        assert row.n == seen[row.src_ip]


def test_running_flows(spark):
    rng = random.Random(5)
    rows, now = [], 10**15
    for i in range(600):
        now += rng.randint(1, 40 * S)
        rows.append((i, now, rng.choice("ab"), "z", 1, 443, "TCP", rng.choice(["S", "SA", "PA", "FR", ""]), rng.randint(40, 1500)))
    df = spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int,"
                               " dst_port int, protocol string, tcp_flags string, bytes long")
    got = {r.packet_id: r for r in flows.running_flows(df).collect()}
    state = defaultdict(list)
    for row in rows:
        flow = state[row[2]]
        flow.append(row)
        sizes = [r[8] for r in flow]
        mean = sum(sizes) / len(sizes)
        seconds = max((row[1] - flow[0][1]) / 1e6, 1e-6)
        mine = got[row[0]]
        assert mine.total_fwd_packets == len(flow) and mine.total_fwd_bytes == sum(sizes)
        assert mine.syn_flag_count == sum("S" in r[7] for r in flow)
        assert mine.flow_packets_per_s == pytest.approx(len(flow) / seconds)
        spread = max(0.0, sum(s * s for s in sizes) / len(sizes) - mean * mean) ** 0.5
        assert mine.packet_length_std == pytest.approx(spread, abs=1e-6)
    last = {r.src_ip: r for r in flows.flows(df).collect()}
    for src, flow in state.items():
        assert last[src].total_fwd_packets == len(flow)
        assert last[src].flow_duration_us == got[flow[-1][0]].flow_duration_us


def dns_rows(seed, n=1500):
    rng = random.Random(seed)
    rows, now = [], 10**15
    for i in range(n):
        busy = (i // 300) % 2
        now += rng.randint(1, 700_000 if busy else 20 * S)
        host = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.choice([3, 8, 40, 70])))
        name = rng.choice([f"{host}.t.example", f"h{rng.randint(1, 40)}.x.example.", "lone", " www.a.b "])
        rows.append((i, now, rng.choice("aab"), name, rng.choice(["A", "TXT", "16"])))
    return rows


def test_dns_reasons(spark):
    import math

    rows = dns_rows(7)
    df = spark.createDataFrame(rows, "dns_id long, ts_us long, src_ip string, qname string, qtype string")
    got = {r.dns_id: r.dns_reasons for r in dns.dns_reasons(df, chunk=10 * S).collect()}

    def base(name):
        labels = [p for p in name.strip(".").lower().split(".") if p]
        return ".".join(labels[-2:]) if len(labels) > 2 else name.strip(".").lower()

    def entropy(name):
        name = name.replace(".", "")
        return -sum(name.count(c) / len(name) * math.log2(name.count(c) / len(name)) for c in set(name))

    kinds = set()
    for i, (key, ts, src, raw, kind) in enumerate(rows):
        name = raw.strip()
        window = [r for r in rows[: i + 1] if r[2] == src and ts - r[1] <= 60 * S]
        names = {r[3].strip() for r in window}
        per_base = defaultdict(set)
        for n in names:
            per_base[base(n)].add(n)
        flags = {
            "dns_long_qname": len(name) >= 60,
            "dns_high_entropy_qname": entropy(name) >= 3.8,
            "dns_txt_query": kind in ("TXT", "16"),
            "dns_many_unique_queries": len(names) >= 40,
            "dns_txt_burst": sum(r[4] in ("TXT", "16") for r in window) >= 15,
            "dns_subdomain_churn": any(b and len(s) >= 25 for b, s in per_base.items()),
        }
        flags["dns_tunnel_suspected"] = (
            flags["dns_high_entropy_qname"] and flags["dns_many_unique_queries"]
            or flags["dns_subdomain_churn"] and flags["dns_long_qname"]
        )
        assert got[key] == [k for k, on in flags.items() if on]
        kinds |= {k for k, on in flags.items() if on}
    assert len(kinds) == 7


def greedy(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("step", [2_000, 200, 30])
def test_debounce(spark, step):
    rng = random.Random(step)
    times = defaultdict(list)
    for src in "abc":
        now = 0
        for _ in range(300):
            now += rng.randint(1, step if src != "c" else 5) * S
            times[src].append(now)
    df = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts], "src_ip string, ts_us long")
    got = defaultdict(list)
    for r in alerts.debounce(df, 600).orderBy("ts_us").collect():
        got[r.src_ip].append(r.ts_us)
    assert got == {s: greedy(ts, 600 * S) for s, ts in times.items()}


def test_burst_alerts(spark):
    rng = random.Random(11)
    rows, now = [], 10**15
    for i in range(500):
        now += rng.randint(1, 60) * S
        label = rng.choice(["dangerous", "Dangerous", "suspicious", "safe"])
        rows.append((i, now, rng.choice("ab"), label, rng.random(), [rng.choice(["x", " y ", "", "z"]), f"r{i % 7}"]))
    df = spark.createDataFrame(
        rows, "id long, ts_us long, src_ip string, classification string, risk_score double, reasons array<string>")
    got = {(r.src_ip, r.ts_us): (r.burst_count, r.reasons) for r in alerts.burst_alerts(df).collect()}
    want = {}
    for src in "ab":
        kept = [r for r in rows if r[2] == src and (r[3].lower() == "dangerous" or r[3] == "suspicious" and r[4] >= 0.78)]
        last = None
        for r in kept:
            window = [x for x in kept if r[1] - 1200 * S <= x[1] <= r[1]]
            if len(window) > 10 and (last is None or r[1] - last >= 600 * S):
                last = r[1]
                reasons = sorted({q.strip() for x in window for q in x[5]} - {""})
                want[(src, r[1])] = (len(window), reasons[:80])
    assert want and got == want


def test_cache_as_of(spark):
    writes = spark.createDataFrame(
        [("k", "ip", 10, 30, "safe", 0.1), ("k", "ip", 20, 25, "malicious", 0.9)],
        "lookup_key string, lookup_type string, cached_us long, expires_us long, verdict string, score double")
    events = spark.createDataFrame([(i, t, "k", "ip") for i, t in enumerate((9, 10, 20, 24, 25, 29))],
                                   "id long, ts_us long, lookup_key string, lookup_type string")
    got = [r.v for r in intel.cache_as_of(events, writes, chunk=7).select("id", F.col("cached.verdict").alias("v")).orderBy("id").collect()]
    assert got == [None, "safe", "malicious", "malicious", None, None]


def test_systematic_sample(packets):
    rows, df = packets
    seen, want = defaultdict(int), set()
    for row in rows:
        seen[row[2]] += 1
        if seen[row[2]] % 4 == 0:
            want.add(row[0])
    assert {r.packet_id for r in maintain.systematic_sample(df, 4, chunk=S).collect()} == want


def test_char_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",), ("zzzz",)], "s string")
    assert [r[0] for r in df.select(text.char_entropy(F.col("s"))).collect()] == [1.0, 0.0, 2.0, 0.0]


def test_hot_sources_are_cut(spark):
    """Sources of many rows are cut, others not; both give what the whole window gives."""
    df = spark.createDataFrame(traffic(8, 1500), "packet_id long, ts_us long, src_ip string, dst_port int")
    counts = sorted(r["count"] for r in df.groupBy("src_ip").count().collect())
    assert len(counts) > 1
    for n in (counts[0], counts[-1] - 1, 0):
        cut = behavior.detect(df, hot_rows=n).select("packet_id", "behavior")
        assert sorted(cut.collect()) == sorted(behavior.detect(df).select("packet_id", "behavior").collect())
    queries = spark.createDataFrame(dns_rows(4, 600), "dns_id long, ts_us long, src_ip string, qname string, qtype string")
    cut = dns.dns_reasons(queries, hot_rows=20)
    whole = dns.dns_reasons(queries)
    assert cut.columns == whole.columns and sorted(cut.collect(), key=str) == sorted(whole.collect(), key=str)
    one = behavior.flood(df.withColumn("src_ip", F.lit(None).cast("string")), hot_rows=3)
    assert one.count() == df.count() and one.agg(F.max("recent_packets")).head()[0] > 1


def test_a_flooding_minute_is_many_tasks(spark):
    """A million rows of one source in one minute: no window partition takes five in a hundred."""
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id").alias("packet_id"), (F.col("id") * 60 + 7 * 60_000_000).alias("ts_us"), F.lit("a").alias("src_ip"),
        (F.col("id") % 7).cast("int").alias("dst_port"),
    )
    placed = prefix._place(df.withColumn("_at", F.col("ts_us")), prefix.HOT_CUT)
    assert placed.groupBy("_part").count().agg(F.max("count")).head()[0] < n / 20
    found = behavior.flood(df, n=50_000, window_s=3, hot_rows=1000)
    assert found.where("recent_packets <> least(packet_id + 1, 50001)").count() == 0
    assert found.where("is_flood").count() == n - 50_000


def test_whole_sources_are_dealt_by_their_rows(spark, monkeypatch):
    """The number of tasks follows the rows, not the session, and the rows are those of one task a source."""
    made = [(i, 1_700_000_000 * S + i * 300_000 * (i % 3), f"s{i % 40}", i % 23) for i in range(3_000)]
    df = spark.createDataFrame(made, "packet_id long, ts_us long, src_ip string, dst_port int")
    operators = {
        "detect": lambda: behavior.detect(df, 5, 30, 4, 60), "history": lambda: behavior.detect(df, 5, 30, 4, 60, history=6),
        "flood": lambda: behavior.flood(df, 5, 30), "port_scan": lambda: behavior.port_scan(df, 4, 30),
    }
    before = {name: sorted(make().collect(), key=str) for name, make in operators.items()}
    monkeypatch.setattr(prefix, "TASK_ROWS", 100)
    assert prefix.hot_keys(df, ["src_ip"]) == (None, prefix.Whole(30))
    for name, make in operators.items():
        got = make()
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect(), key=str) == before[name]


def test_stays_of_whole_keys_are_their_edges(spark):
    """Gaps to neighbours give the instants that edges per row give, at a gap of just the window and without a time."""
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, *range(0, 400, 3)])) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("c", "x", 0), ("c", "x", 11), ("c", "x", 23), (None, "x", 5), ("c", None, 7)], "k string, i string, t long")
    want = prefix.crossings(prefix.enter_leave(df.where("i IS NOT NULL"), ["k", "i"], "t", 10), ["k", "i"], ["k"], "d", 1, None)
    for chunk in (None, prefix.Whole(5)):
        got = prefix.distinct_edges(df, ["k"], "i", "t", 10, "d", chunk)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.columns == want.columns


def test_names_are_dealt_once(spark, monkeypatch):
    """Names of a source and of its bases come from one pass over the rows."""
    df = spark.createDataFrame(dns_rows(4, 300), "dns_id long, ts_us long, src_ip string, qname string, qtype string")
    calls, plain = [], dns.distinct_edges
    monkeypatch.setattr(dns, "distinct_edges", lambda *args: calls.append(args) or plain(*args))
    assert dns.dns_reasons(df).count() == df.where("trim(qname) <> ''").count() and len(calls) == 1


def test_base_domains_with_and_without_empty_labels(spark):
    names = {"a.b.c": "b.c", "A.B": "a.b", "x": "x", "": "", "..": "", "a..b": "a..b", ".a..b.c.": "b.c", "a.b..C": "b.c", " w.a.b ": "a.b ", None: ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.b for r in df.select("n", text.base_domain(F.col("n")).alias("b")).collect()} == names


def test_entropy_is_taken_once_a_name(spark):
    """The plan on the rows holds no entropy, and its values are those of every row by itself."""
    df = spark.createDataFrame(dns_rows(5, 300), "dns_id long, ts_us long, src_ip string, qname string, qtype string")
    got = dns.dns_reasons(df)
    assert "array_distinct" not in got._jdf.queryExecution().executedPlan().toString()
    want = dns.dns_flags(df)
    assert [c for c in got.columns if c != "dns_reasons"] == want.columns
    assert Counter(map(tuple, got.drop("dns_reasons").collect())) == Counter(map(tuple, want.collect()))
