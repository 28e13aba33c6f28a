"""DNS tunnelling signs per query and in a sliding window per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text
from packetloom.operators.behavior import SECOND_US
from packetloom.operators.prefix import (
    attach, by_density, crossings, distinct_edges, leaving,
)
from packetloom.session import staged

TXT_CODES = ("TXT", "16")  # fixed values: record type by name and by number


def _typed(queries: DataFrame) -> DataFrame:
    """Trimmed name, whether the type is TXT, and base domain (B5); no empty names."""
    name = F.trim(F.col("qname"))
    is_txt = F.upper(F.col("qtype").cast("string")).isin(*TXT_CODES)
    return queries.where(name != "").withColumn("qname", name).withColumns(
        {"is_txt": F.coalesce(is_txt, F.lit(False)), "base_domain": text.base_domain(F.col("qname"))}
    )


def _weighed(named: DataFrame) -> DataFrame:
    """Add the entropy of a name's characters."""
    held = named.withColumn("_bare", F.replace("qname", F.lit("."), F.lit("")))
    return held.withColumn("name_entropy", text.char_entropy(F.col("_bare"))).drop("_bare")


def with_names(queries: DataFrame) -> DataFrame:
    """Trimmed name, type, base domain (B5) and character entropy (B6); no empty names."""
    return _weighed(_typed(queries))


def _flagged(weighed: DataFrame, long: int, entropy: float) -> DataFrame:
    return weighed.withColumns(
        {
            "long_qname": F.length("qname") >= long,
            "high_entropy": F.col("name_entropy") >= entropy,
        }
    )


def dns_flags(queries: DataFrame, long: int = 60, entropy: float = 3.8) -> DataFrame:
    """Signs visible in one query."""
    return _flagged(_weighed(_typed(queries)), long, entropy)


@by_density
def unique_queries(
    queries: DataFrame, n: int = 40, window_s: float = 60, chunk: int | None = None
) -> DataFrame:
    """Distinct names of a source in the window."""
    named = with_names(queries)
    width = int(window_s * SECOND_US)
    out = attach(
        named, ["src_ip"], "ts_us", sums={"unique_qnames": F.lit(0).cast("long")},
        edges=[distinct_edges(named, ["src_ip"], "qname", "ts_us", width, "unique_qnames", chunk)],
        chunk=chunk,
    )
    return out.withColumn("many_unique", F.col("unique_qnames") >= n)


@by_density
def txt_burst(
    queries: DataFrame, n: int = 15, window_s: float = 60, chunk: int | None = None
) -> DataFrame:
    """TXT queries of a source in the window."""
    named = with_names(queries)
    is_txt = F.col("is_txt").cast("long")
    out = attach(
        named, ["src_ip"], "ts_us", sums={"txt_queries": is_txt},
        edges=[leaving(named, ["src_ip"], "ts_us", int(window_s * SECOND_US), "txt_queries", is_txt)],
        chunk=chunk,
    )
    return out.withColumn("txt_burst", F.col("txt_queries") >= n)


def _name_edges(named: DataFrame, width: int, chunk: int | None) -> DataFrame:
    """Edges of the number of distinct names of a source and base domain, which is that of a source too: a name has one base."""
    return distinct_edges(named, ["src_ip", "base_domain"], "qname", "ts_us", width, "_d", chunk)


def _churn_edges(names: DataFrame, n: int, out: str, chunk: int | None) -> DataFrame:
    """Edges of "number of base domains with at least n distinct names in the window"."""
    return crossings(names.where(F.col("base_domain") != ""), ["src_ip", "base_domain"], ["src_ip"], out, n, chunk)


@by_density
def subdomain_churn(
    queries: DataFrame, n: int = 25, window_s: float = 60, chunk: int | None = None
) -> DataFrame:
    """Some base domain has at least ``n`` distinct names in the window."""
    named = with_names(queries)
    width = int(window_s * SECOND_US)
    out = attach(
        named, ["src_ip"], "ts_us", sums={"_busy_bases": F.lit(0).cast("long")},
        edges=[_churn_edges(_name_edges(named, width, chunk), n, "_busy_bases", chunk)], chunk=chunk,
    )
    return out.withColumn("subdomain_churn", F.col("_busy_bases") > 0).drop("_busy_bases")


@by_density
def dns_reasons(
    queries: DataFrame, window_s: float = 60, long: int = 60, entropy: float = 3.8,
    unique: int = 40, txt: int = 15, churn: int = 25, chunk: int | None = None,
) -> DataFrame:
    """B7-B11 together: the ``dns_reasons`` of each query, in a fixed order."""
    width = int(window_s * SECOND_US)
    src, is_txt, none = ["src_ip"], F.col("is_txt").cast("long"), F.lit(0).cast("long")
    named = _typed(queries)
    names = staged(_name_edges(named, width, chunk))  # read twice: as they are, and for the bases
    seen = attach(
        named, src, "ts_us",
        sums={"_names": none, "_txt": is_txt, "_bases": none},
        edges=[
            names.select(*src, "_at", F.col("_d").alias("_names")),
            leaving(named, src, "ts_us", width, "_txt", is_txt),
            _churn_edges(names, churn, "_bases", chunk),
        ],
        chunk=chunk,
    )
    # The entropy of a name takes longer than all else of a row: it is taken once a name.
    weights = staged(_weighed(named.select("qname").distinct()))
    seen = seen.drop("name_entropy")
    seen = seen.join(weights, "qname", "left").select(*[f"`{c}`" for c in seen.columns], "name_entropy")
    seen = _flagged(seen, long, entropy)
    many, churned = F.col("_names") >= unique, F.col("_bases") > 0
    tunnel = (F.col("high_entropy") & many) | (churned & F.col("long_qname"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("long_qname"), "dns_long_qname"),
            F.when(F.col("high_entropy"), "dns_high_entropy_qname"),
            F.when(F.col("is_txt"), "dns_txt_query"),
            F.when(many, "dns_many_unique_queries"),
            F.when(F.col("_txt") >= txt, "dns_txt_burst"),
            F.when(churned, "dns_subdomain_churn"),
            F.when(tunnel, "dns_tunnel_suspected"),
        )
    )
    return seen.withColumn("dns_reasons", reasons).drop("_names", "_txt", "_bases")


def dns_queries(messages: DataFrame) -> DataFrame:
    """Questions only (qr = 0 with at least one question)."""
    return messages.where((F.col("qr") == 0) & (F.col("qdcount") > 0))
