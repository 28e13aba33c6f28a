"""From model outputs and signals to an explained verdict per packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import risk
from packetloom.functions.text import byte_entropy
from packetloom.operators import behavior as behave
from packetloom.operators import content, flows, intel


def _none() -> Column:
    return F.array().cast("array<string>")


def _or(df: DataFrame, name: str, default: Column) -> Column:
    """A column, or the default where it is absent or NULL."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def score_models(df: DataFrame, has_iso: bool = True, trusted: bool = True) -> DataFrame:
    """M7-M9: from rf_prob and either iso_raw or anomaly_strength, with rf_pred, iso_pred."""
    if "anomaly_strength" not in df.columns:
        df = df.withColumns(
            {
                "iso_score": risk.iso_probability(F.col("iso_raw")),
                "anomaly_strength": risk.anomaly_strength(F.col("iso_raw"), F.col("iso_pred")),
            }
        )
    rf, strength = F.col("rf_prob"), F.col("anomaly_strength")
    scored = df.withColumn("ml_score", risk.hybrid_score(rf, strength, has_iso))
    return scored.withColumns(
        {
            "confidence": risk.confidence(rf, strength, trusted),
            "ml_reasons": risk.ml_reasons(rf, strength),
            "ai_label": risk.ml_label(F.col("ml_score"), rf, strength),
        }
    )


def own_signals(df: DataFrame, trusted: bool = True) -> DataFrame:
    """Boost, reasons and attack flag before outside sources are asked.

    Reads ml_score, ml_reasons, rf_pred, iso_pred, anomaly_strength, behavior and, where
    present, payload_entropy, unusual_port, flow_packets_per_s, is_https, dst_port,
    content_reasons and dns_reasons.
    """
    entropy = _or(df, "payload_entropy", F.lit(0.0))
    pps = _or(df, "flow_packets_per_s", F.lit(0.0))
    unusual = F.col("unusual_port") if "unusual_port" in df.columns else F.lit(None).cast("int")
    mismatch = F.lit(False)
    if "is_https" in df.columns:
        mismatch = risk.https_mismatch(F.col("is_https"), F.col("dst_port"))
    found, dns = _or(df, "content_reasons", _none()), _or(df, "dns_reasons", _none())
    behavior = F.col("behavior")

    first = F.concat(
        F.col("ml_reasons"), risk.heuristic_reasons(entropy, unusual, pps, mismatch), found,
        F.array_compact(F.array(behavior)),
    )
    strong = (F.col("iso_pred") == -1) & (F.col("anomaly_strength") >= 0.40)
    held = df.withColumn("_first", first)
    reasons = F.concat(
        F.col("_first"), F.array_except(dns, F.col("_first")),
        F.array_compact(
            F.array(
                F.when(F.col("rf_pred") == 1, "ml_attack"), F.when(strong, "anomaly"),
                F.lit(None if trusted else "ml_model_untrusted").cast("string"),
            )
        ),
    )
    held = held.withColumns(
        {
            "reasons": reasons,
            "heuristic_boost": risk.heuristic_boost(entropy, unusual, pps, mismatch),
            "ai_score": F.col("ml_score") * (1.0 if trusted else 0.92),
            "_n_dns": F.size(dns),
        }
    ).drop("_first")
    held = held.withColumn(
        "attack_signals", risk.attack_signals(F.col("reasons"), behavior, F.col("rf_pred"))
    )
    return held.withColumn(
        "adjusted_score",
        risk.adjusted_score(
            F.col("ai_score"), behavior, F.col("_n_dns"), F.col("heuristic_boost"),
            F.col("attack_signals"),
        ),
    ).drop("_n_dns")


def fuse(
    df: DataFrame, dangerous: float = risk.DANGEROUS, suspicious: float = risk.SUSPICIOUS
) -> DataFrame:
    """Fold ti_ip, ti_url, zeek and intel_reasons into risk and class."""

    def says(name: str) -> tuple[Column, Column, Column]:
        if name not in df.columns:
            return F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("double")
        return F.col(name).isNotNull(), F.col(f"{name}.verdict"), F.col(f"{name}.score")

    extra = _or(df, "intel_reasons", _none())
    ip, url, zeek = says("ti_ip"), says("ti_url"), says("zeek")
    logs = F.lit(False)
    if "zeek" in df.columns:
        logs = F.coalesce(F.col("zeek.logs_available"), F.lit(False))
    held = df.withColumn(
        "reasons", F.concat("reasons", F.array_except(extra, F.col("reasons")))
    ).withColumns(
        {
            "attack_signals": risk.attack_signals(
                F.col("reasons"), F.col("behavior"), F.col("rf_pred")
            ),
            "_intel": F.greatest(risk.source_score(*ip), risk.source_score(*url)),
            "_floor": F.greatest(risk.intel_floor(*ip[1:]), risk.intel_floor(*url[1:])),
            "_zeek": risk.source_score(*zeek),
        }
    )
    held = held.withColumn(
        "risk_score",
        risk.final_risk(
            F.col("ai_score"), F.col("adjusted_score"), F.col("_intel"), F.col("_floor"),
            F.col("_zeek"), logs, F.col("attack_signals"),
        ),
    )
    return held.withColumn(
        "classification",
        risk.classify(
            F.col("risk_score"), F.col("ai_label"), F.col("reasons"), F.col("behavior"),
            F.col("rf_pred"), F.col("attack_signals"), dangerous, suspicious,
        ),
    ).drop("_intel", "_floor", "_zeek")


def explain(
    df: DataFrame, dangerous: float = risk.DANGEROUS, suspicious: float = risk.SUSPICIOUS,
    digits: int | None = 4,
) -> DataFrame:
    """Add the ``explanation`` struct; ``digits=None`` keeps values unrounded."""

    def shown(name: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None).cast("double")
        return value if digits is None else F.bround(value, digits)

    return df.withColumn(
        "explanation",
        F.struct(
            shown("ml_score").alias("ml_score"),
            shown("adjusted_score").alias("adjusted_score"),
            shown("risk_score").alias("fused_risk"), F.col("ai_label").alias("ml_label"),
            shown("rf_prob").alias("rf_prob"), shown("anomaly_strength").alias("anomaly_strength"),
            shown("iso_score").alias("iso_score"), F.col("behavior"), F.col("attack_signals"),
            shown("heuristic_boost").alias("heuristic_boost"),
            F.struct(
                F.lit(suspicious).alias("suspicious"), F.lit(dangerous).alias("dangerous")
            ).alias("thresholds"),
            F.col("reasons"),
        ),
    )


def score_records(
    df: DataFrame, sources: dict | None = None, has_iso: bool = True, trusted: bool = True,
    dangerous: float = risk.DANGEROUS, suspicious: float = risk.SUSPICIOUS,
    digits: int | None = 4,
) -> DataFrame:
    """M7-M9, R1-R9 and T13 over records that carry model outputs and behaviour.

    ``sources`` are the keyword arguments of intel.enrich(); without them no outside
    source is asked.
    """
    scored = own_signals(score_models(df, has_iso, trusted), trusted)
    if sources is not None:
        scored = intel.enrich(scored, trusted=trusted, **sources)
    return explain(fuse(scored, dangerous, suspicious), dangerous, suspicious, digits)


def score_packets(
    packets: DataFrame, models, sources: dict | None = None, behavior: dict | None = None,
    dns: DataFrame | None = None, digits: int | None = 4,
) -> DataFrame:
    """Packets to verdicts: flow features, models, behaviour, content, intel, class.

    ``models`` has predict(df) -> rf_pred, rf_prob, iso_pred, iso_raw and the flags
    ``has_iso`` and ``trusted`` (ml.Models). ``behavior`` are the parameters of
    behavior.detect(). ``dns`` has packet_id and dns_reasons.
    """
    ready = packets
    if "payload" in packets.columns:
        # Payloads are read where they are and do not travel with the packets.
        ready = content.assemble_url(content.http_requests(packets)).withColumn(
            "payload_entropy", byte_entropy(F.col("payload").cast("binary"))
        ).drop("payload")
    if {"http", "url", "payload_preview"} & set(ready.columns):
        ready = content.content_reasons(ready)
    seen = flows.port_class(flows.features(flows.running_flows(ready, base=packets)))
    narrow = packets.select("packet_id", "src_ip", "ts_us", "dst_port")
    noted = behave.detect(narrow, **(behavior or {})).where(F.col("behavior").isNotNull())
    seen = seen.join(noted.select("packet_id", "behavior"), "packet_id", "left")
    if dns is not None:
        seen = seen.join(dns.select("packet_id", "dns_reasons"), "packet_id", "left")
    return score_records(
        models.predict(seen), None if sources is None else {"base": packets, **sources},
        models.has_iso, models.trusted, digits=digits,
    )

