"""Registered queries: model scores, risk fusion and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import risk
from packetloom.operators import scoring
from packetloom.plans.adapters import adapt
from packetloom.plans.registry import query

_D = "CAST({} AS DOUBLE)"


def _records(spark, sf_dir):
    """Scored records in the shape R1-R9 take."""
    def intel(prefix):
        verdict, score = F.col(f"{prefix}_verdict"), F.col(f"{prefix}_score")
        return F.when(
            verdict.isNotNull() | score.isNotNull(), F.struct(verdict.alias("verdict"), score.alias("score"))
        )

    names = F.array(*[F.lit(n) for n in (
        "dns_long_qname", "dns_high_entropy_qname", "dns_txt_query", "dns_txt_burst",
        "dns_subdomain_churn", "dns_tunnel_suspected")])
    return _with_signals(adapt(spark, sf_dir, "scored"), intel, names)


def _with_signals(rows, intel, names):
    zeek = F.struct(
        F.lit("suspicious").alias("verdict"), F.col("zeek_score").alias("score"),
        F.lit(True).alias("logs_available"),
    )
    return rows.withColumns(
        {
            "rf_pred": (F.col("rf_prob") >= 0.5).cast("int"),
            "iso_pred": F.when(F.col("strength") > 0, -1).otherwise(1),
            "anomaly_strength": F.col("strength"),
            "payload_entropy": F.col("entropy"),
            "flow_packets_per_s": F.col("pps"),
            "dns_reasons": F.slice(names, 1, F.col("n_dns")),
            "ti_ip": intel("ip"), "ti_url": intel("url"),
            "zeek": F.when(F.col("zeek_logs"), zeek),
            "intel_reasons": F.array_compact(
                F.array(
                    F.when(F.col("ip_verdict") != "unknown", F.concat(F.lit("reputation_ip_"), F.col("ip_verdict"))),
                    F.when(F.col("url_verdict") != "unknown", F.concat(F.lit("reputation_url_"), F.col("url_verdict"))),
                )
            ),
        }
    )


_WRF = "CAST(CASE WHEN rf_prob > 0.80 THEN 0.78 WHEN rf_prob < 0.20 THEN 0.30 WHEN rf_prob < 0.45 THEN 0.42 ELSE 0.58 END AS DOUBLE)"
_WISO = "CAST(CASE WHEN rf_prob > 0.80 THEN 0.22 WHEN rf_prob < 0.20 THEN 0.70 WHEN rf_prob < 0.45 THEN 0.58 ELSE 0.42 END AS DOUBLE)"
_ML = f"""
, m AS (SELECT *, CAST(rf_prob >= 0.5 AS INT) AS rf_pred, CASE WHEN strength > 0 THEN -1 ELSE 1 END AS iso_pred,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {_WRF} * rf_prob + {_WISO} *
    (CASE WHEN rf_prob < 0.22 AND strength > 0.48 THEN least(strength, CAST(0.40 AS DOUBLE)) ELSE strength END))) AS ml_score FROM scored),
n AS (SELECT *, CASE WHEN ml_score > 0.72 OR (rf_prob > 0.80 AND strength >= 0.38) THEN 'dangerous'
  WHEN ml_score > 0.48 OR (rf_prob > 0.55 AND strength >= 0.30) THEN 'suspicious' ELSE 'safe' END AS ai_label,
  greatest(rf_prob, CAST(1 AS DOUBLE) - strength) AS confidence FROM m)
"""


@query("m8_m9_hybrid", ("scored",), _ML + """
SELECT rec_id, ml_score, ai_label, confidence, concat_ws(',', CASE WHEN rf_prob > 0.65 THEN 'high_rf_attack_probability' END,
  CASE WHEN strength >= 0.55 THEN 'strong_anomaly_detected' END, CASE WHEN rf_prob > 0.4 AND strength > 0.3 THEN 'combined_ml_signals' END) AS ml_reasons FROM n
""")
def m8_m9_hybrid(spark, sf_dir):
    return scoring.score_models(_records(spark, sf_dir)).select(
        "rec_id", "ml_score", "ai_label", "confidence", F.array_join("ml_reasons", ",").alias("ml_reasons")
    )


@query("m7_anomaly_strength", ("scored",), """
SELECT rec_id, floor(CASE WHEN rec_id % 2 = 0 THEN 1 - 1 / (1 + exp(-(rf_prob - 0.5))) ELSE 0 END * 100000) / 100000 AS strength FROM scored
""")
def m7_anomaly_strength(spark, sf_dir):
    pred = F.when(F.col("rec_id") % 2 == 0, -1).otherwise(1)
    value = risk.anomaly_strength(F.col("rf_prob") - 0.5, pred)
    return adapt(spark, sf_dir, "scored").select(
        "rec_id", (F.floor(value * 100_000) / 100_000).alias("strength")
    )


_SIG = _ML + f"""
, s AS (SELECT *,
  (CASE WHEN entropy > 7.2 THEN least({_D.format(0.10)}, (entropy - 7) * {_D.format(0.06)}) ELSE 0 END)
  + {_D.format('CASE WHEN unusual_port IS NOT NULL THEN 0.06 ELSE 0 END')}
  + (CASE WHEN pps > 500 THEN least({_D.format(0.12)}, pps / 6000) ELSE 0 END) AS boost,
  coalesce(behavior IN ('flood', 'port_scan'), false) OR rf_pred = 1 OR rf_prob > 0.65 OR strength >= 0.55
    OR (rf_prob > 0.4 AND strength > 0.3) OR strength >= 0.40 AS attack FROM n),
a AS (SELECT *, least({_D.format('CASE WHEN attack THEN 0.35 ELSE 0.18 END')}, boost + {_D.format("CASE behavior WHEN 'flood' THEN 0.28 WHEN 'port_scan' THEN 0.20 WHEN 'dns_tunnel' THEN 0.14 ELSE 0 END")}
  + least({_D.format(0.12)}, n_dns * {_D.format(0.03)})) AS lift, {_D.format('CASE WHEN attack THEN 0.35 ELSE 0.18 END')} AS cap FROM s),
j AS (SELECT *, CASE WHEN lift <= 0 THEN ml_score ELSE least({_D.format(1)}, ml_score + lift * (1 - ml_score * {_D.format(0.45)}), ml_score + cap) END AS adjusted_score FROM a)
"""


@query("r1_r3_own_signals", ("scored",), _SIG + """
SELECT rec_id, boost AS heuristic_boost, attack AS attack_signals, adjusted_score,
  concat_ws(',', CASE WHEN rf_prob > 0.65 THEN 'high_rf_attack_probability' END, CASE WHEN strength >= 0.55 THEN 'strong_anomaly_detected' END,
  CASE WHEN rf_prob > 0.4 AND strength > 0.3 THEN 'combined_ml_signals' END, CASE WHEN entropy > 7.2 THEN 'high_payload_entropy' END,
  CASE WHEN unusual_port IS NOT NULL THEN concat('unusual_port_', unusual_port) END, CASE WHEN pps > 500 THEN 'traffic_burst' END, behavior,
  nullif(array_to_string(['dns_long_qname', 'dns_high_entropy_qname', 'dns_txt_query', 'dns_txt_burst', 'dns_subdomain_churn'][1:n_dns], ','), ''),
  CASE WHEN rf_pred = 1 THEN 'ml_attack' END, CASE WHEN strength >= 0.40 THEN 'anomaly' END) AS reasons FROM j
""")
def r1_r3_own_signals(spark, sf_dir):
    scored = scoring.own_signals(scoring.score_models(_records(spark, sf_dir)))
    return scored.select(
        "rec_id", "heuristic_boost", "attack_signals", "adjusted_score", F.array_join("reasons", ",").alias("reasons")
    )


def _source(verdict: str, score: str) -> str:
    return (f"CASE WHEN {verdict} IS NULL AND {score} IS NULL THEN 0 ELSE coalesce({score}, {_D.format(f'''CASE {verdict} WHEN 'malicious' THEN 0.85 WHEN 'suspicious' THEN 0.45 WHEN 'safe' THEN 0 ELSE 0.08 END''')}) END")


def _floor(verdict: str, score: str) -> str:
    return (f"CAST(CASE WHEN coalesce({verdict} = 'malicious', false) OR coalesce({score}, 0) >= 0.90 THEN 0.88"
            f" WHEN coalesce({verdict} = 'suspicious', false) OR coalesce({score}, 0) >= 0.50 THEN 0.58 ELSE 0 END AS DOUBLE)")


_FUSED = _SIG + f"""
, t AS (SELECT *, greatest({_source('ip_verdict', 'ip_score')}, {_source('url_verdict', 'url_score')}) AS ti,
  greatest({_floor('ip_verdict', 'ip_score')}, {_floor('url_verdict', 'url_score')}) AS fl FROM j),
w AS (SELECT *, {_D.format('CASE WHEN ti >= 0.85 THEN CASE WHEN attack THEN 0.45 ELSE 0.32 END WHEN attack THEN 0.28 ELSE 0.16 END')} AS tw,
  {_D.format('CASE WHEN attack THEN 0.50 ELSE 0.30 END')} AS gate FROM t),
f1 AS (SELECT *, CASE WHEN ti > 0 THEN least({_D.format(1)}, greatest(ml_score, adjusted_score) + ti * least({_D.format(1)}, greatest(gate, ml_score / {_D.format(0.55)})) * tw)
  ELSE greatest(ml_score, adjusted_score) END AS r1 FROM w),
f2 AS (SELECT *, CASE WHEN zeek_logs THEN least({_D.format(1)}, r1 + zeek_score * {_D.format(0.12)}) ELSE r1 END AS r2 FROM f1),
f3 AS (SELECT *, least({_D.format(1)}, greatest(r2, fl, ml_score + CASE WHEN attack THEN {_D.format(0.35)} * 0.5 ELSE {_D.format(0.18)} * {_D.format(0.3)} END)) AS risk FROM f2),
c AS (SELECT *, CASE WHEN risk >= 0.78 THEN 'dangerous' WHEN risk >= 0.52 THEN 'suspicious'
  WHEN ip_verdict = 'malicious' THEN CASE WHEN risk >= 0.72 THEN 'dangerous' ELSE 'suspicious' END
  WHEN ip_verdict = 'suspicious' THEN 'suspicious' WHEN behavior = 'flood' THEN 'suspicious' WHEN behavior = 'port_scan' THEN 'suspicious'
  WHEN rf_pred = 1 AND risk >= 0.45 THEN 'suspicious' WHEN attack AND risk >= 0.50 THEN 'suspicious'
  WHEN ai_label = 'suspicious' AND risk >= 0.42 THEN 'suspicious' ELSE 'safe' END AS classification FROM f3)
"""


@query("r4_r7_fused_risk", ("scored",), _FUSED + "SELECT rec_id, risk AS risk_score, classification FROM c")
def r4_r7_fused_risk(spark, sf_dir):
    scored = scoring.own_signals(scoring.score_models(_records(spark, sf_dir)))
    return scoring.fuse(scored).select("rec_id", "risk_score", "classification")


# The ladder on its own, with risks that reach every rung.
_CUT = "CAST((rec_id * 7 % 900) / 1000.0 AS DOUBLE)"


@query("r7_ladder", ("scored",), f"""
, r AS (SELECT rec_id, {_CUT} AS risk, CASE rec_id % 3 WHEN 0 THEN 'dangerous' WHEN 1 THEN 'suspicious' ELSE 'safe' END AS label,
  CASE rec_id % 7 WHEN 0 THEN 'reputation_ip_malicious' WHEN 1 THEN 'reputation_url_malicious' WHEN 2 THEN 'reputation_ip_suspicious'
    WHEN 3 THEN 'ml_attack' WHEN 4 THEN 'http_xss' ELSE 'base' END AS reason,
  CASE rec_id % 11 WHEN 0 THEN 'flood' WHEN 1 THEN 'port_scan' END AS behavior, CAST(rec_id % 5 = 0 AS INT) AS rf_pred, rec_id % 2 = 0 AS attack FROM scored)
SELECT rec_id, CASE WHEN risk >= 0.78 THEN 'dangerous' WHEN risk >= 0.70 THEN 'suspicious' WHEN risk >= 0.60 THEN 'suspicious' WHEN risk >= 0.52 THEN 'suspicious'
  WHEN reason LIKE 'reputation%' THEN 'suspicious' WHEN behavior IS NOT NULL THEN 'suspicious' WHEN rf_pred = 1 AND risk >= 0.48 THEN 'suspicious'
  WHEN reason = 'ml_attack' AND risk >= 0.45 THEN 'suspicious' WHEN attack AND reason = 'http_xss' THEN 'suspicious' WHEN attack AND risk >= 0.50 THEN 'suspicious'
  WHEN label = 'suspicious' AND risk >= 0.42 THEN 'suspicious' ELSE 'safe' END AS at_default,
  CASE WHEN risk >= 0.85 THEN 'dangerous' WHEN risk >= 0.80 THEN 'suspicious' WHEN reason = 'reputation_ip_malicious' THEN CASE WHEN risk >= 0.72 THEN 'dangerous' ELSE 'suspicious' END
  WHEN reason = 'reputation_url_malicious' THEN CASE WHEN risk >= 0.70 THEN 'dangerous' ELSE 'suspicious' END WHEN reason = 'reputation_ip_suspicious' THEN 'suspicious'
  WHEN behavior = 'flood' THEN CASE WHEN risk >= 0.55 THEN 'dangerous' ELSE 'suspicious' END WHEN behavior = 'port_scan' THEN CASE WHEN risk >= 0.65 THEN 'dangerous' ELSE 'suspicious' END
  WHEN rf_pred = 1 AND risk >= 0.48 THEN CASE WHEN risk >= 0.62 THEN 'dangerous' ELSE 'suspicious' END
  WHEN reason = 'ml_attack' AND risk >= 0.45 THEN CASE WHEN risk >= 0.60 THEN 'dangerous' ELSE 'suspicious' END
  WHEN attack AND reason = 'http_xss' THEN CASE WHEN risk >= 0.58 THEN 'dangerous' ELSE 'suspicious' END WHEN attack AND risk >= 0.50 THEN 'suspicious'
  WHEN label = 'dangerous' AND risk >= 0.55 THEN 'dangerous' WHEN label = 'suspicious' AND risk >= 0.42 THEN 'suspicious' ELSE 'safe' END AS at_raised FROM r
""")
def r7_ladder(spark, sf_dir):
    n = F.col("rec_id")
    label = F.when(n % 3 == 0, "dangerous").when(n % 3 == 1, "suspicious").otherwise("safe")
    names = ("reputation_ip_malicious", "reputation_url_malicious", "reputation_ip_suspicious", "ml_attack", "http_xss", "base", "base")
    reason = F.array(F.array(*[F.lit(x) for x in names])[(n % 7).cast("int")])
    behavior = F.when(n % 11 == 0, "flood").when(n % 11 == 1, "port_scan")
    args = (label, reason, behavior, (n % 5 == 0).cast("int"), n % 2 == 0)
    cut = F.expr(_CUT)
    return adapt(spark, sf_dir, "scored").select(
        "rec_id", risk.classify(cut, *args).alias("at_default"),
        risk.classify(cut, *args, dangerous=0.85, suspicious=0.80).alias("at_raised"),
    )


@query("r9_explanation", ("scored",), _FUSED + """
SELECT rec_id, ml_score AS e_ml, adjusted_score AS e_adjusted, risk AS e_risk, ai_label AS e_label, attack AS e_attack, behavior AS e_behavior FROM c
""")
def r9_explanation(spark, sf_dir):
    rows = scoring.score_records(_records(spark, sf_dir), digits=None)
    return rows.select(
        "rec_id", F.col("explanation.ml_score").alias("e_ml"), F.col("explanation.adjusted_score").alias("e_adjusted"),
        F.col("explanation.fused_risk").alias("e_risk"), F.col("explanation.ml_label").alias("e_label"),
        F.col("explanation.attack_signals").alias("e_attack"), F.col("explanation.behavior").alias("e_behavior"),
    )


@query("r11_classify_by_count", ("logs",), """
SELECT id, CASE WHEN ai_label = 'dangerous' OR list_contains(reasons, 'ml_attack') OR len(reasons) >= 2 THEN 'dangerous'
  WHEN ai_label = 'suspicious' OR list_contains(reasons, 'anomaly') THEN 'suspicious' ELSE 'safe' END AS classification FROM logs
""")
def r11_classify_by_count(spark, sf_dir):
    return adapt(spark, sf_dir, "logs").select(
        "id", risk.classify_by_count(F.col("ai_label"), F.col("reasons")).alias("classification")
    )
