"""Column functions that turn model outputs and signals into risk and class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, boosts and weights of the scoring rules.
DANGEROUS = 0.78
SUSPICIOUS = 0.52
BENIGN_CAP = 0.18
ATTACK_CAP = 0.35
BEHAVIOR_BOOST = {
    "port_scan": 0.20,
    "flood": 0.28,
    "dns_tunnel": 0.14,
    "dns_tunnel_suspected": 0.16,
    "dns_suspicious": 0.10,
}
ATTACK_PREFIXES = (
    "http_", "payload_", "ml_attack", "strong_anomaly", "high_rf_attack", "combined_ml",
)


def clamp(value: Column) -> Column:
    """Into 0..1; NULL stays NULL, which least() and greatest() would skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _no(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _any(flags: list[Column]) -> Column:
    return reduce(Column.__or__, flags)


# ---- model outputs -------------------------------------------------------------------


def iso_probability(raw: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-raw))


def anomaly_strength(raw: Column, iso_pred: Column) -> Column:
    """M7: how far a flagged row is from normal; 0 when the model did not flag it."""
    return F.when(iso_pred == -1, 1.0 - iso_probability(raw)).otherwise(0.0)


def hybrid_score(rf: Column, strength: Column, has_iso: bool = True) -> Column:
    """M8: forest and anomaly model weighted by how sure the forest is."""
    if not has_iso:
        return clamp(rf * 1.0)
    weight = (
        F.when(rf > 0.80, 0.78).when(rf < 0.20, 0.30).when(rf < 0.45, 0.42).otherwise(0.58)
    )
    iso_weight = (
        F.when(rf > 0.80, 0.22).when(rf < 0.20, 0.70).when(rf < 0.45, 0.58).otherwise(0.42)
    )
    damped = (rf < 0.22) & (strength > 0.48)
    shown = F.when(damped, F.least(strength, F.lit(0.40))).otherwise(strength)
    return clamp(weight * rf + iso_weight * shown)


def confidence(rf: Column, strength: Column, trusted: bool = True) -> Column:
    return F.greatest(rf, 1.0 - strength) if trusted else 1.0 - strength


def ml_reasons(rf: Column, strength: Column) -> Column:
    """M9."""
    return F.array_compact(
        F.array(
            F.when(rf > 0.65, "high_rf_attack_probability"),
            F.when(strength >= 0.55, "strong_anomaly_detected"),
            F.when((rf > 0.4) & (strength > 0.3), "combined_ml_signals"),
        )
    )


def ml_label(score: Column, rf: Column, strength: Column) -> Column:
    """M9."""
    return (
        F.when((score > 0.72) | ((rf > 0.80) & (strength >= 0.38)), "dangerous")
        .when((score > 0.48) | ((rf > 0.55) & (strength >= 0.30)), "suspicious")
        .otherwise("safe")
    )


# ---- signals -------------------------------------------------------------------------


def heuristic_boost(entropy: Column, unusual: Column, pps: Column, mismatch: Column) -> Column:
    """Boost; heuristic_reasons() has the matching reasons."""
    return (
        F.when(entropy > 7.2, F.least(F.lit(0.10), (entropy - 7.0) * 0.06)).otherwise(0.0)
        + F.when(F.coalesce(unusual, F.lit(0)) != 0, 0.06).otherwise(0.0)
        + F.when(pps > 500, F.least(F.lit(0.12), pps / 6000.0)).otherwise(0.0)
        + F.when(mismatch, 0.04).otherwise(0.0)
    )


def heuristic_reasons(entropy: Column, unusual: Column, pps: Column, mismatch: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(entropy > 7.2, "high_payload_entropy"),
            F.when(
                F.coalesce(unusual, F.lit(0)) != 0,
                F.concat(F.lit("unusual_port_"), unusual.cast("string")),
            ),
            F.when(pps > 500, "traffic_burst"),
            F.when(mismatch, "https_port_mismatch"),
        )
    )


def https_mismatch(is_https: Column, port: Column) -> Column:
    return _no(is_https & ~F.coalesce(port.isin(443, 8443), F.lit(False)))


def attack_signals(reasons: Column, behavior: Column, rf_pred: Column) -> Column:
    """R2: any evidence of an attack, as opposed to mere noise."""
    telling = F.exists(
        reasons,
        lambda r: (r == "anomaly") | _any([F.lower(r).startswith(p) for p in ATTACK_PREFIXES]),
    )
    return _no(behavior.isin("port_scan", "flood")) | _no(rf_pred == 1) | _no(telling)


def adjusted_score(
    ml: Column, behavior: Column, n_dns: Column, boost: Column, attack: Column
) -> Column:
    """The model score lifted by behaviour and heuristics, up to a cap."""
    base = clamp(ml)
    by_behavior = F.lit(0.10)
    for name, value in BEHAVIOR_BOOST.items():
        by_behavior = F.when(behavior == name, value).otherwise(by_behavior)
    cap = F.when(attack, ATTACK_CAP).otherwise(BENIGN_CAP)
    extra = (
        F.coalesce(boost, F.lit(0.0))
        + F.when(F.coalesce(behavior, F.lit("")) != "", by_behavior).otherwise(0.0)
        + F.least(F.lit(0.12), F.coalesce(n_dns, F.lit(0)) * 0.03)
    )
    lift = F.least(cap, extra)
    lifted = F.least(F.lit(1.0), base + lift * (1.0 - base * 0.45), base + cap)
    return F.when(lift <= 0, base).otherwise(lifted)


def source_score(present: Column, verdict: Column, score: Column) -> Column:
    """How much one intel source alone says."""
    by_verdict = (
        F.when(F.lower(verdict) == "malicious", 0.85)
        .when(F.lower(verdict) == "suspicious", 0.45)
        .when(F.lower(verdict) == "safe", 0.0)
        .otherwise(0.08)
    )
    return F.when(present, F.coalesce(clamp(score), by_verdict)).otherwise(0.0)


def intel_floor(verdict: Column, score: Column) -> Column:
    """Least risk of a record one intel source has confirmed."""
    known = F.coalesce(score, F.lit(0.0))
    return (
        F.when(_no(F.lower(verdict) == "malicious") | (known >= 0.90), 0.88)
        .when(_no(F.lower(verdict) == "suspicious") | (known >= 0.50), 0.58)
        .otherwise(0.0)
    )


def final_risk(
    ml: Column, adjusted: Column, intel: Column, floor: Column,
    zeek: Column, zeek_logs: Column, attack: Column,
) -> Column:
    """``intel`` / ``zeek`` are source_score values, ``floor`` the larger intel_floor."""
    base = clamp(ml)
    weight = F.when(intel >= 0.85, F.when(attack, 0.45).otherwise(0.32)).otherwise(
        F.when(attack, 0.28).otherwise(0.16)
    )
    gate = F.when(attack, 0.50).otherwise(0.30)
    risk = F.greatest(base, adjusted)
    trust = F.least(F.lit(1.0), F.greatest(gate, base / 0.55))
    risk = F.when(intel > 0, F.least(F.lit(1.0), risk + intel * trust * weight)).otherwise(risk)
    risk = F.when(zeek_logs, F.least(F.lit(1.0), risk + zeek * 0.12)).otherwise(risk)
    least_lift = F.when(attack, ATTACK_CAP * 0.5).otherwise(BENIGN_CAP * 0.3)
    return F.least(F.lit(1.0), F.greatest(risk, floor, base + least_lift))


def classify(
    risk: Column, label: Column, reasons: Column, behavior: Column, rf_pred: Column,
    attack: Column, dangerous: float = DANGEROUS, suspicious: float = SUSPICIOUS,
) -> Column:
    """Ordered rules; the first that applies decides."""

    def starts(prefix: str) -> Column:
        return _no(F.exists(reasons, lambda r: r.startswith(prefix)))

    def at_least(limit: float) -> Column:
        return F.when(risk >= limit, "dangerous").otherwise("suspicious")

    return (
        F.when(risk >= dangerous, "dangerous")
        .when(risk >= suspicious, "suspicious")
        .when(starts("reputation_ip_malicious"), at_least(0.72))
        .when(starts("reputation_url_malicious"), at_least(0.70))
        .when(starts("reputation_ip_suspicious"), "suspicious")
        .when(behavior == "flood", at_least(0.55))
        .when(behavior == "port_scan", at_least(0.65))
        .when((rf_pred == 1) & (risk >= 0.48), at_least(0.62))
        .when(_no(F.array_contains(reasons, "ml_attack")) & (risk >= 0.45), at_least(0.60))
        .when(attack & starts("http_"), at_least(0.58))
        .when(attack & (risk >= 0.50), "suspicious")
        .when((label == "dangerous") & (risk >= 0.55), "dangerous")
        .when((label == "suspicious") & (risk >= 0.42), "suspicious")
        .otherwise("safe")
    )


def classify_by_count(label: Column, reasons: Column) -> Column:
    """The older rule that counts reasons."""
    return (
        F.when(
            (label == "dangerous") | F.array_contains(reasons, "ml_attack") | (F.size(reasons) >= 2),
            "dangerous",
        )
        .when((label == "suspicious") | F.array_contains(reasons, "anomaly"), "suspicious")
        .otherwise("safe")
    )


def known_class(stored: Column) -> Column:
    """A stored class; missing or unknown ones count as safe."""
    low = F.lower(stored)
    return F.when(low.isin("suspicious", "dangerous"), low).otherwise("safe")


def effective_class(
    stored: Column, risk: Column, ai: Column,
    dangerous: float = DANGEROUS, suspicious: float = SUSPICIOUS,
) -> Column:
    """Q9: stored class if it is a known one, else by risk, else by model score."""
    low = F.lower(stored)
    score = F.coalesce(risk, ai)
    return (
        F.when(low.isin("safe", "suspicious", "dangerous"), low)
        .when(score >= dangerous, "dangerous")
        .when(score >= suspicious, "suspicious")
        .otherwise("safe")
    )


def trend_score(ai: Column, risk: Column, label: Column) -> Column:
    """Q10: model score, else risk, else a value typical of the class."""
    typical = F.when(label == "dangerous", 0.9).when(label == "suspicious", 0.55).otherwise(0.08)
    return F.coalesce(ai, risk, typical)
