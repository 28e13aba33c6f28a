"""Column functions on names, URLs and JSON text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RISKY_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".zip", ".mov")  # fixed values
RISKY_WORDS = ("login", "verify", "account", "secure", "update", "wallet", "php?")  # fixed values


def char_entropy(value: Column) -> Column:
    """Shannon entropy in bits of the characters of a short string, best a held column."""
    size = F.length(value)
    counts = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda char: (size - F.length(F.replace(value, char, F.lit("")))).cast("double"),
    )
    weighed = F.aggregate(counts, F.lit(0.0), lambda total, n: total + n * F.log2(n))
    return F.when(size > 0, F.log2(size) - weighed / size).otherwise(0.0)


#: Bytes of a payload that are counted at once.
PIECE = 1 << 20


@F.pandas_udf(T.DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy in bits of payload bytes, one Arrow batch at a time."""

    def bits(data: bytes | None) -> float:
        if not data:
            return 0.0
        held = np.frombuffer(data, dtype=np.uint8)
        # bincount copies what it counts as 8 bytes each.
        counts = sum(np.bincount(held[k : k + PIECE], minlength=256) for k in range(0, len(held), PIECE))
        share = counts[counts > 0] / len(data)
        return float(-(share * np.log2(share)).sum())

    return payload.map(bits)


def base_domain(name: Column) -> Column:
    """The last two labels, lower case, outer dots removed."""
    clean = F.lower(F.trim(F.coalesce(name, F.lit("")), F.lit(".")))
    labels = F.filter(F.split(clean, r"\."), lambda part: part != "")
    # Only names with empty labels inside need their labels one by one.
    return F.when(~F.contains(clean, F.lit("..")), F.substring_index(clean, ".", -2)).when(F.size(labels) <= 2, clean).otherwise(
        F.array_join(F.slice(labels, -2, 2), ".")
    )


def url_domain(url: Column) -> Column:
    """Authority part (port and user info kept), lower case; the scheme is optional."""
    absolute = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    rest = F.regexp_replace(absolute, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.trim(F.when(authority != "", authority).otherwise(path)))


def url_score(url: Column, domain: Column) -> Column:
    """Score of a URL from its text alone."""
    low, host = F.lower(url), F.lower(domain)
    risky_end = F.lit(False)
    for tld in RISKY_TLDS:
        risky_end = risky_end | host.endswith(tld)
    wordy = F.lit(False)
    for word in RISKY_WORDS:
        wordy = wordy | low.contains(word)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    score = F.greatest(
        F.when(risky_end, 0.5).otherwise(0.0),
        F.when(wordy & host.rlike("[0-9]"), 0.55).otherwise(0.0),
        F.when(dots >= 3, 0.4).otherwise(0.0),
    )
    return F.when(F.coalesce(domain, F.lit("")) != "", score).otherwise(0.0)


def url_verdict(domain: Column, score: Column) -> Column:
    return (
        F.when(F.coalesce(domain, F.lit("")) == "", "unknown")
        .when(score > 0, "suspicious")
        .otherwise("safe")
    )


def event_host(url: Column, http_host: Column | None = None) -> Column:
    """Q13: host of an event, lower case and without port; NULL when there is none."""
    raw = F.trim(url)
    absolute = F.regexp_extract(raw, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    bare = F.split(F.split(raw, "/").getItem(0), ":").getItem(0)
    from_url = F.when(raw.rlike("(?i)^https?://"), F.nullif(absolute, F.lit(""))).when(
        raw.contains(".") & ~raw.startswith("/"), F.nullif(bare, F.lit(""))
    )
    if http_host is not None:
        own = F.split(http_host, ":").getItem(0)
        from_url = F.coalesce(F.when(http_host != "", own), from_url)
    return F.lower(from_url)


def decode_reasons(raw: Column) -> Column:
    """Reasons kept as JSON text, whatever state the text is in."""
    parsed = F.try_parse_json(raw)
    as_list = F.from_json(raw, "array<string>")
    one = F.coalesce(F.try_variant_get(parsed, "$", "string"), raw)
    return (
        F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>"))
        .when(parsed.isNull(), F.array(F.lit("_reasons_json_parse_error")))
        .when(F.is_variant_null(parsed), F.array().cast("array<string>"))
        .when(F.schema_of_variant(parsed).startswith("ARRAY"), F.array_compact(as_list))
        .otherwise(F.array(one))
    )


def decode_object(raw: Column) -> Column:
    """JSON text of an object; broken text and plain values are wrapped, not lost."""
    parsed = F.try_parse_json(raw)
    kind = F.schema_of_variant(parsed)
    broken = F.to_json(
        F.struct(
            F.lit(True).alias("_parse_error"), raw.alias("_raw")
        )
    )
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(parsed.isNull(), broken)
        .when(
            kind.startswith("OBJECT"),
            F.when(F.to_json(parsed) != "{}", raw),
        )
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))
    )


def intel_summary(intel: dict[str, Column]) -> Column:
    """Q22: one line of text from the fields of an intel object."""
    fields = ("verdict", "category", "risk", "source", "asn", "country", "provider", "reason")
    parts = [
        F.when(intel[f].cast("string") != "", intel[f].cast("string"))
        for f in fields if f in intel
    ]
    if "score" in intel:
        score = intel["score"].cast("string")
        parts.append(F.when(score != "", F.concat(F.lit("score="), score)))
    line = F.concat_ws(" · ", *parts)
    if "value" in intel:
        line = F.when(line == "", F.coalesce(intel["value"].cast("string"), F.lit(""))).otherwise(line)
    if "_parse_error" in intel:
        line = F.when(F.coalesce(intel["_parse_error"], F.lit(False)), "data error (see raw)").otherwise(line)
    return line
