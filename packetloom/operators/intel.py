"""Reputation of addresses and URLs.

Feeds are tables that shrink to one row per indicator before they join. Spark picks the
join by measured size, so a feed that outgrows a broadcast is shuffled instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import net, text
from packetloom.functions.risk import clamp
from packetloom.operators.prefix import MINUTE_US, attach

RANK = {"safe": 0, "unknown": 1, "suspicious": 2, "malicious": 3}  # fixed values
TTL_S, TTL_MIN_S, TTL_MAX_S = 3600, 60, 86_400  # fixed values
FINDING = "indicator string, provider string, verdict string, score double"


def _rank(verdict: Column) -> Column:
    rank = F.lit(0)
    for name, value in RANK.items():
        rank = F.when(verdict == name, value).otherwise(rank)
    return F.when(verdict.isNull(), RANK["unknown"]).otherwise(rank)


def _named(rank: Column) -> Column:
    name = F.lit("unknown")
    for label, value in RANK.items():
        name = F.when(rank == value, label).otherwise(name)
    return name


def with_private(df: DataFrame, col: str = "src_ip") -> DataFrame:
    """T1."""
    return df.withColumn("is_private", net.is_private(F.col(col)))


# ---- blocklist ------------------------------------------------------------------------


def _split_cidr(value: Column) -> tuple[Column, Column]:
    base = net.ipv4_number(F.get(F.split(value, "/"), F.lit(0)))
    given = F.get(F.split(value, "/"), F.lit(1)).try_cast("int")
    length = F.when(~value.contains("/"), 32).otherwise(given)
    return base, F.when(length.between(0, 32), length)


def _mask(number: Column, length: Column) -> Column:
    """Network part of an address: its low 32 - length bits dropped."""
    size = F.pow(F.lit(2.0), 32 - length).cast("long")
    return number - F.pmod(number, size)


def _network_key(number: Column, length: Column) -> Column:
    return F.concat_ws("/", _mask(number, length).cast("string"), length.cast("string"))


def match_blocklist(
    df: DataFrame, blocklist: DataFrame, col: str = "src_ip", exact: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add ``listed``; ``base`` is a cheaper table with the same addresses.

    ``blocklist`` has ``value``: an address or an IPv4 network. Networks become an
    equi-join on (masked address, prefix length), one key per length the list has (33 at
    most). ``exact`` compares text only.
    """
    entries = blocklist.select(F.trim("value").alias("value")).distinct()
    ips = (df if base is None else base).select(F.trim(F.col(col)).alias("_ip"))
    ips = ips.where(F.col("_ip").isNotNull()).distinct()
    if exact:
        keyed = entries.select(F.col("value").alias("_network"))
        probes = ips.select("_ip", F.col("_ip").alias("_network"))
    else:
        base, length = _split_cidr(F.col("value"))
        parsed = entries.withColumns({"base": base, "length": length})
        lengths = sorted(r[0] for r in parsed.select("length").distinct().collect() if r[0] is not None)
        keyed = parsed.select(
            F.when(F.col("base").isNotNull() & F.col("length").isNotNull(),
                   _network_key(F.col("base"), F.col("length")))
            .otherwise(F.col("value")).alias("_network")
        ).distinct()
        known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
        # NULL numbers (no IPv4) leave only the text itself as a key.
        networks = F.array_compact(
            F.transform(known, lambda n: F.when(F.col("_number").isNotNull(), _network_key(F.col("_number"), n)))
        )
        numbered = ips.withColumn("_number", net.ipv4_number(F.col("_ip")))
        probes = numbered.select(
            "_ip", F.explode(F.concat(networks, F.array("_ip"))).alias("_network")
        )
    hits = probes.join(keyed, "_network", "left_semi").select("_ip").distinct()
    joined = df.join(
        hits.withColumn("_hit", F.lit(True)), F.trim(F.col(col)) == F.col("_ip"), "left"
    )
    return joined.withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("_hit", "_ip")


# ---- feeds to findings ----------------------------------------------------------------


def _finding(provider: str, verdict: Column, score: Column) -> list[Column]:
    return [
        F.col("indicator"), F.lit(provider).alias("provider"), verdict.alias("verdict"),
        score.cast("double").alias("score"),
    ]


def abuse_verdict(feed: DataFrame) -> DataFrame:
    """Abuse score 0-100 (``abuse_score``)."""
    score = F.coalesce(F.col("abuse_score"), F.lit(0.0))
    verdict = F.when(score >= 70, "malicious").when(score >= 30, "suspicious").otherwise("safe")
    return feed.select(*_finding("abuseipdb", verdict, clamp(score / 100)))


def meta_verdict(feed: DataFrame) -> DataFrame:
    """T4: address metadata (``proxy``, ``hosting``); private addresses are not rated."""
    score = F.greatest(
        F.when(F.col("proxy"), 0.45).otherwise(0.0), F.when(F.col("hosting"), 0.35).otherwise(0.0)
    )
    verdict = F.when(score > 0, "suspicious").otherwise("safe")
    return feed.where(~net.is_private(F.col("indicator"))).select(*_finding("ip-api", verdict, score))


def vote_verdict(feed: DataFrame) -> DataFrame:
    """T5: engine votes (``malicious``, ``suspicious``, ``undetected``)."""
    bad, odd, clear = (F.coalesce(F.col(c), F.lit(0)) for c in ("malicious", "suspicious", "undetected"))
    score = clamp((bad + odd * 0.5) / F.greatest(F.lit(1), bad + odd + clear))
    verdict = F.when(bad > 0, "malicious").when(odd > 0, "suspicious").otherwise("safe")
    return feed.select(*_finding("virustotal", verdict, score))


def url_heuristics(df: DataFrame, col: str = "url") -> DataFrame:
    """Add ``domain``, ``url_score`` and ``url_verdict``."""
    domain = text.url_domain(F.col(col))
    held = df.withColumn("domain", domain)
    score = text.url_score(F.col(col), F.col("domain"))
    return held.withColumn("url_score", score).withColumn(
        "url_verdict", text.url_verdict(F.col("domain"), F.col("url_score"))
    )


def merge_providers(findings: DataFrame) -> DataFrame:
    """Worst verdict and score per indicator, with its providers.

    Starting at unknown, "safe" never wins; a score of 0 is none. Each provider shrinks
    to one entry before its indicator is put together, so no group outgrows the number
    of providers.
    """
    each = findings.groupBy("indicator", "provider").agg(
        F.max(_rank(F.col("verdict"))).alias("_rank"), F.max("score").alias("score")
    )
    entry = F.struct("provider", _named(F.col("_rank")).alias("verdict"), "score")
    return each.groupBy("indicator").agg(
        _named(F.greatest(F.max("_rank"), F.lit(RANK["unknown"]))).alias("verdict"),
        F.max(F.when(F.col("score") > 0, F.col("score"))).alias("score"),
        F.array_sort(F.collect_list(entry)).alias("providers"),
    )


def _no_findings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING)


def lookup_ips(
    ips: DataFrame, blocklist: DataFrame | None = None, abuse: DataFrame | None = None,
    meta: DataFrame | None = None, col: str = "src_ip", exact: bool = False,
) -> DataFrame:
    """One intel row per distinct address; private ones are safe without look-up."""
    wanted = ips.select(F.trim(F.col(col)).alias("indicator")).where(
        F.coalesce("indicator", F.lit("")) != ""
    ).distinct()
    wanted = wanted.withColumn("is_private", net.is_private(F.col("indicator")))
    public = wanted.where(~F.col("is_private"))
    parts = []
    if blocklist is not None:
        hits = match_blocklist(public, blocklist, "indicator", exact).where("listed")
        parts.append(hits.select(*_finding("local_blocklist", F.lit("malicious"), F.lit(1.0))))
    if abuse is not None:
        parts.append(abuse_verdict(abuse))
    if meta is not None:
        parts.append(meta_verdict(meta))
    merged = merge_providers(reduce(DataFrame.unionByName, parts) if parts else _no_findings(ips))
    joined = wanted.join(merged, "indicator", "left")
    private = F.col("is_private")
    return joined.select(
        F.lit("ip").alias("type"), "indicator",
        F.when(private, "local").otherwise("aggregated").alias("provider"),
        F.when(private, "safe").otherwise(F.coalesce("verdict", F.lit("unknown"))).alias("verdict"),
        F.when(private, 0.0).otherwise(F.col("score")).alias("score"),
        F.when(private, F.lit(None)).otherwise(F.col("providers")).alias("providers"),
    )


def lookup_urls(urls: DataFrame, votes: DataFrame | None = None, col: str = "url") -> DataFrame:
    """One intel row per distinct URL; ``votes`` is keyed by domain."""
    wanted = urls.select(F.col(col).alias("indicator")).where(
        F.coalesce("indicator", F.lit("")) != ""
    ).distinct()
    rated = url_heuristics(wanted, "indicator")
    own = rated.select(
        "indicator", F.lit("heuristic").alias("provider"), F.col("url_verdict").alias("verdict"),
        F.col("url_score").alias("score"),
    )
    if votes is not None:
        # One row per domain first: joining raw votes would repeat them for every URL.
        by_domain = vote_verdict(votes).groupBy(F.col("indicator").alias("domain")).agg(
            F.max(_rank(F.col("verdict"))).alias("_rank"), F.max("score").alias("score")
        )
        voted = rated.select("indicator", "domain").join(by_domain, "domain").select(
            "indicator", F.lit("virustotal").alias("provider"), _named(F.col("_rank")).alias("verdict"), "score"
        )
        own = own.unionByName(voted.where((F.col("verdict") != "unknown") | (F.col("score") > 0)))
    return merge_providers(own).select(
        F.lit("url").alias("type"), "indicator", F.lit("aggregated").alias("provider"),
        "verdict", "score", "providers", text.url_domain(F.col("indicator")).alias("domain"),
    )


# ---- cache ----------------------------------------------------------------------------


def cache_get(
    keys: DataFrame, cache: DataFrame, as_of: Column, key: str = "lookup_key",
    kind: str = "lookup_type",
) -> DataFrame:
    """Add the ``cached`` entry (verdict, score) of each key still valid at ``as_of``.

    The cache holds one row per key and kind, as cache_put() leaves it.
    """
    entry = F.struct("verdict", "score").alias("cached")
    valid = cache.where(F.col("expires_at") > as_of).select(key, kind, entry)
    return keys.join(valid, [key, kind], "left")


def cache_as_of(
    events: DataFrame, cache_log: DataFrame, at: str = "ts_us", key: str = "lookup_key",
    kind: str = "lookup_type", chunk: int = MINUTE_US,
) -> DataFrame:
    """T11 at each event's own time: the newest entry written by then, unless expired.

    ``cache_log`` keeps every write (cached_us, expires_us). The newest write so far is a
    running maximum, so no event is paired with all writes of its key.
    """
    fields = ("cached_us", "expires_us", "verdict", "score")
    write = F.struct(*fields)
    kept = cache_log.select(key, kind, F.col("cached_us").alias("_at"), write.alias("_write"))
    empty = F.lit(None).cast(kept.schema["_write"].dataType)
    seen = attach(
        events, [key, kind], at, maxs={"_write": empty}, edges=[kept], chunk=chunk
    )
    valid = F.col("_write.expires_us") > F.col(at)
    return seen.withColumn(
        "cached", F.when(valid, F.struct("_write.verdict", "_write.score"))
    ).drop("_write")


def cache_put(
    cache: DataFrame, rows: DataFrame, ttl_s: int = TTL_S, clamp_ttl: bool = False,
    key: str = "lookup_key", kind: str = "lookup_type",
) -> DataFrame:
    """The cache with ``rows`` (…, cached_at) written into it; the newest write wins."""
    ttl = max(TTL_MIN_S, min(ttl_s, TTL_MAX_S)) if clamp_ttl else ttl_s
    expires = F.timestamp_micros(F.unix_micros("cached_at") + ttl * 1_000_000)
    both = cache.unionByName(rows.withColumn("expires_at", expires))
    rest = [c for c in both.columns if c not in (key, kind)]
    return both.groupBy(key, kind).agg(
        F.max_by(F.struct(*rest), F.struct("cached_at", "expires_at")).alias("_row")
    ).select(key, kind, "_row.*")


# ---- enrichment of scored records -----------------------------------------------------


def _reason(prefix: str, verdict: Column) -> Column:
    return F.when(verdict != "unknown", F.concat(F.lit(prefix), verdict))


def _cached(cache: DataFrame | None, kind: str, as_of: Column | None) -> DataFrame | None:
    """Valid entries of one kind as (_key, _cached)."""
    if cache is None:
        return None
    now = F.current_timestamp() if as_of is None else as_of
    valid = cache.where((F.col("lookup_type") == kind) & (F.col("expires_at") > now))
    return valid.select(
        F.col("lookup_key").alias("_key"), F.struct("verdict", "score").alias("_cached")
    )


def _ask(
    rows: DataFrame, asks: Column, key: Column, found: DataFrame | None,
    cached: DataFrame | None, default: Column, out: str,
) -> DataFrame:
    """Add ``out`` to rows that ask: the cached entry, else the found one, else a default.

    Both tables have one row per key. The gate is part of the join condition, so rows that
    do not ask match nothing and keep their own key, which spreads them.
    """
    answer = default
    if found is not None:
        rows = rows.join(found, asks & (key == F.col("_key")), "left").drop("_key")
        answer = F.coalesce("_found", answer)
    if cached is not None:
        rows = rows.join(cached, asks & (key == F.col("_key")), "left").drop("_key")
        answer = F.coalesce("_cached", answer)
    return rows.withColumn(out, F.when(asks, answer.cast(_INTEL))).drop("_found", "_cached")


_INTEL = "struct<verdict:string,score:double>"


def _pair(verdict: Column, score: Column) -> Column:
    return F.struct(verdict.alias("verdict"), score.cast("double").alias("score"))


def enrich(
    df: DataFrame, blocklist: DataFrame | None = None, abuse: DataFrame | None = None,
    meta: DataFrame | None = None, votes: DataFrame | None = None,
    zeek: DataFrame | None = None, cache: DataFrame | None = None,
    cache_as_of_time: Column | None = None, min_score: float = 0.25, full: float = 0.45,
    trusted: bool = True, pressure: float = 0.0, skip_heavy: bool = False,
    exact: bool = False, base: DataFrame | None = None,
) -> DataFrame:
    """Add ti_ip, ti_url, zeek and ``intel_reasons`` to scored records.

    Needs src_ip, adjusted_score and behavior; url is optional. The blocklist is always
    consulted, other sources only for records above the gate. Feeds shrink to one row per
    indicator and join the records directly; what a URL itself shows needs no join.
    ``base`` is a cheaper table with the same addresses for the blocklist match.
    """
    gate = max(min_score, 0.0 if trusted else 0.40, 0.50 if pressure > 0.5 else 0.0)
    heavy = not (skip_heavy or pressure > 0.75)
    rows = df.withColumn("_private", net.is_private(F.col("src_ip")))
    blocked = F.lit(False)
    if blocklist is not None:
        rows = match_blocklist(rows, blocklist, "src_ip", exact, base)
        blocked = F.col("listed") & ~F.col("_private")
    elevated = (
        (F.col("adjusted_score") >= gate)
        | F.coalesce(F.col("behavior").isin("port_scan", "flood"), F.lit(False))
    )
    rows = rows.withColumn("_blocked", blocked).drop("listed")
    rows = rows.withColumn("_open", F.lit(heavy) & (elevated | F.col("_blocked")))

    feeds = [f for f in (
        None if abuse is None else abuse_verdict(abuse), None if meta is None else meta_verdict(meta)
    ) if f is not None]
    found = None
    if feeds:
        found = merge_providers(reduce(DataFrame.unionByName, feeds)).select(
            F.col("indicator").alias("_key"), _pair(F.col("verdict"), F.col("score")).alias("_found")
        )
    asks_ip = F.col("_open") & ~F.col("_blocked") & (F.col("src_ip") != "")
    outside = asks_ip & ~F.col("_private")
    cached = _cached(cache, "ip", cache_as_of_time)
    rows = _ask(
        rows, outside, F.trim("src_ip"), found, cached,
        _pair(F.lit("unknown"), F.lit(None)), "ti_ip",
    )
    rows = rows.withColumn(
        "ti_ip",
        F.when(F.col("_blocked"), _pair(F.lit("malicious"), F.lit(1.0)))
        .when(asks_ip & F.col("_private"), _pair(F.lit("safe"), F.lit(0.0)))
        .otherwise(F.col("ti_ip")),
    )
    reasons = [_reason("reputation_ip_", F.col("ti_ip.verdict"))]

    if "url" in df.columns:
        bad_ip = F.coalesce(F.col("ti_ip.verdict").isin("suspicious", "malicious"), F.lit(False))
        asks_url = (
            F.col("_open") & (F.coalesce("url", F.lit("")) != "")
            & ((F.col("adjusted_score") >= full) | bad_ip)
        )
        rows = rows.withColumn("_asks_url", asks_url).withColumn(
            "_domain", F.when(F.col("_asks_url"), text.url_domain(F.col("url")))
        ).withColumn("_shown", text.url_score(F.col("url"), F.col("_domain")))
        own = _rank(text.url_verdict(F.col("_domain"), F.col("_shown")))
        worst, score = own, F.col("_shown")
        if votes is not None:
            by_domain = vote_verdict(votes).groupBy(F.col("indicator").alias("_voted")).agg(
                F.max(_rank(F.col("verdict"))).alias("_rank"), F.max("score").alias("_votes")
            )
            rows = rows.join(by_domain, F.col("_asks_url") & (F.col("_domain") == F.col("_voted")), "left")
            worst, score = F.greatest(own, F.col("_rank")), F.greatest(score, F.col("_votes"))
        merged = _pair(
            _named(F.greatest(worst, F.lit(RANK["unknown"]))), F.when(score > 0, score)
        )
        rows = _ask(
            rows, F.col("_asks_url"), F.col("url"), None, _cached(cache, "url", cache_as_of_time),
            merged, "ti_url",
        ).drop("_asks_url", "_domain", "_shown", "_voted", "_rank", "_votes")
    else:
        rows = rows.withColumn("ti_url", F.lit(None).cast(_INTEL))
    reasons.append(_reason("reputation_url_", F.col("ti_url.verdict")))

    signals = F.array().cast("array<string>")
    if zeek is not None and heavy:
        seen = zeek.select(
            F.col("ip").alias("_zeek_ip"),
            F.struct("verdict", "score", "signals", F.lit(True).alias("logs_available"), "reason").alias("zeek"),
        )
        asks = F.col("_open") & ~F.col("_private") & (F.col("src_ip") != "")
        rows = rows.join(seen, asks & (F.col("src_ip") == F.col("_zeek_ip")), "left").drop("_zeek_ip")
        signals = F.array_compact(
            F.concat(F.array("zeek.reason"), F.coalesce("zeek.signals", F.array().cast("array<string>")))
        )
    return rows.withColumn(
        "intel_reasons", F.array_distinct(F.concat(F.array_compact(F.array(*reasons)), signals))
    ).drop("_private", "_blocked", "_open")
