"""Registered queries: training data, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import flows, isolation, ml, scoring
from packetloom.plans.adapters import adapt, table
from packetloom.plans.registry import query
from packetloom.sources import training

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("m1_scale", (), "SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(
    f"floor(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () * 1000000 + 0.5) / 1000000 AS {c}" for c in _NUM
) + " FROM lineitem")
def m1_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *_NUM)
    scaled = ml.scale(rows, _NUM)
    return scaled.withColumns({c: F.floor(F.col(c) * 1_000_000 + 0.5) / 1_000_000 for c in _NUM})


_PLACE = "(event_id * 7919) % 1000003"


@query("m4_split", (), f"""
, e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_PLACE}, event_id) AS n,
  count(*) OVER (PARTITION BY event_type) AS size FROM events)
SELECT event_id, event_type, n <= floor(size * 0.2::DOUBLE + 0.5) AS is_test FROM e
""")
def m4_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ml.split(rows, "event_id", "event_type", order=F.expr(_PLACE), chunk=10_000)


@query("m5_class_report", (), """
, c AS (SELECT 0 AS label UNION ALL SELECT 1),
t AS (SELECT label, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE toxic = label) AS guessed,
  count(*) FILTER (WHERE quality = label AND toxic = label) AS hit FROM c, labels GROUP BY label)
SELECT label, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
  CASE WHEN guessed + support > 0 THEN 2 * hit / (guessed + support) ELSE 0 END AS f1, support FROM t
""")
def m5_class_report(spark, sf_dir):
    return ml.class_report(table(spark, sf_dir, "labels"), "quality", "toxic")


_AUC = """
, s AS (SELECT CAST(value > 60 AND event_id % 3 > 0 AS INT) AS y, CAST(value > 80 AS INT) AS p, least(floor(value) / 256, 1.0) AS score FROM events),
g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) AS below FROM g),
auc AS (SELECT sum(pos * (below - neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc FROM r)
"""


def _judged(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        ((value > 60) & (F.col("event_id") % 3 > 0)).cast("int").alias("label"),
        (value > 80).cast("int").alias("prediction"),
        F.least(F.floor(value) / 256, F.lit(1.0)).alias("score"),
    )


@query("m5_evaluate", (), _AUC + """
, k AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM s)
SELECT floor((tp + tn) / (tp + tn + fp + fn) * 1e9) / 1e9 AS accuracy, floor((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 * 1e9) / 1e9 AS f1_macro,
  floor(roc_auc * 1e9) / 1e9 AS roc_auc FROM k, auc
""")
def m5_evaluate(spark, sf_dir):
    found = ml.evaluate(_judged(spark, sf_dir))
    return found.select(*[(F.floor(F.col(c) * 1e9) / 1e9).alias(c) for c in found.columns])


@query("m12_binary_label", ("logs",), """
SELECT id, CASE WHEN classification = 'safe' OR id % 9 IN (0, 1) THEN 0 ELSE 1 END AS label FROM logs
""")
def m12_binary_label(spark, sf_dir):
    n = F.col("id") % 9
    raw = F.when(n == 0, " Normal ").when(n == 1, "BENIGN").otherwise(F.col("classification"))
    return adapt(spark, sf_dir, "logs").select("id", training.binary_label(raw).alias("label"))


def _stored(spark, sf_dir):
    """Stored training rows: good vectors, broken text, empty lists, short vectors."""
    n = F.col("l_partkey") % 10
    cells = [F.col("l_quantity"), F.col("l_tax"), *[F.lit(float(i)) for i in range(15)]]
    last = F.when(n == 3, "NaN").when(n == 4, "-Infinity").when(n == 5, "null").otherwise("0")
    good = F.concat(
        F.lit("["), F.concat_ws(",", *[c.cast("string") for c in cells], last), F.lit("]")
    )
    text = F.when(n == 0, "[1, 2").when(n == 1, "[]").when(n == 2, "").otherwise(good)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"), text.alias("features_json"),
        F.when(F.col("l_returnflag") == "R", "attack").otherwise("benign").alias("label"),
    )


@query("s3_read_training", (), """
SELECT l_orderkey * 10 + l_linenumber AS rec_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, 18 AS dim,
  l_quantity AS f_0, l_tax AS f_1, CAST(0 AS DOUBLE) AS f_17 FROM lineitem WHERE l_partkey % 10 > 2
""")
def s3_read_training(spark, sf_dir):
    f = F.col("features")
    return training.read_training(_stored(spark, sf_dir), dim=18).select(
        "rec_id", "label", F.size(f).alias("dim"), f[0].alias("f_0"), f[1].alias("f_1"), f[17].alias("f_17")
    )


@query("m15_preview", (), """
SELECT CASE WHEN l_returnflag = 'R' THEN 'attack' ELSE 'benign' END AS label, count(*) AS samples, 18 AS feature_dim,
  (SELECT count(*) FROM lineitem WHERE l_partkey % 10 <= 2) AS skipped_rows, true AS ready FROM lineitem WHERE l_partkey % 10 > 2 GROUP BY 1
""")
def m15_preview(spark, sf_dir):
    return ml.preview(training.parse_vectors(_stored(spark, sf_dir)))


@query("s4_choose_training", (), """
SELECT source, label, count(*) AS n FROM (SELECT 'mysql+sqlite' AS source, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem WHERE l_partkey % 10 > 2) GROUP BY 1, 2
""")
def s4_choose_training(spark, sf_dir):
    rows = training.read_training(_stored(spark, sf_dir))
    stores = {"mysql": rows.where("rec_id % 2 = 0"), "sqlite": rows.where("rec_id % 2 = 1"), "empty": rows.where("rec_id < 0")}
    chosen = training.choose_training(stores=stores)
    return chosen.groupBy("source", "label").agg(F.count("*").alias("n"))


@query("s11_seed_rows", ("packets",), """
, f AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, CAST(count(*) AS DOUBLE) AS n FROM packets GROUP BY ALL),
t AS (SELECT * FROM f ORDER BY src_ip, dst_ip, src_port, dst_port, protocol LIMIT 500)
SELECT dst_port AS port, n AS packets, CASE WHEN protocol = 'TCP' THEN 'benign' ELSE 'attack' END AS label FROM t
""")
def s11_seed_rows(spark, sf_dir):
    flow = flows.flows(adapt(spark, sf_dir, "packets"))
    labelled = flow.withColumn("label", F.when(F.col("protocol") == "TCP", 0).otherwise(1))
    seeded = training.seed_rows(labelled, 1.0, 500, flows.FLOW_KEY)
    vector = F.from_json("features_json", "array<double>")
    return seeded.select(vector[0].cast("int").alias("port"), vector[2].alias("packets"), "label")


def _vectors(spark, sf_dir):
    """Embeddings as features: the label is that of the rarer classes."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("label") % 2).alias("label"),
    )


@query("m2_forest", ())
def m2_forest(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = ml.fit_forest(rows, trees=20, depth=6)
    return ml.attack_probability(rows, model).select("vec_id", "label", "rf_prob")


@query("m3_isolation", ())
def m3_isolation(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = isolation.fit_isolation(rows, "vec_id", trees=50)
    return model.transform(rows).select("vec_id", "iso_raw", "iso_pred")


@query("m13_m14_retrain", ())
def m13_m14_retrain(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    models, first = ml.retrain(rows, "vec_id", dim=64, trees=20, depth=6, isolation_trees=30)
    _, second = ml.retrain(rows, "vec_id", models, dim=64, extra_trees=10, depth=6, isolation_trees=30)
    return first.unionByName(second)


@query("r10_score_packets", ("packets",))
def r10_score_packets(spark, sf_dir):
    """Packets through features, freshly trained models, behaviour, content, intel and fusion."""
    packets = adapt(spark, sf_dir, "packets")
    day = 86_400
    flow = flows.features(flows.flows(packets)).withColumn(
        "flow_id", F.xxhash64(*flows.FLOW_KEY)
    )
    labelled = flow.withColumn("label", (F.col("total_fwd_bytes") > 140).cast("int"))
    models, _ = ml.retrain(labelled, "flow_id", trees=10, depth=6, isolation_trees=30)
    scored = scoring.score_packets(
        packets, models,
        {"abuse": adapt(spark, sf_dir, "abuse_feed"), "meta": adapt(spark, sf_dir, "meta_feed")},
        {"flood_n": 6, "flood_s": day, "scan_n": 4, "scan_s": 2 * day},
    )
    return scored.select(
        "packet_id", "classification", "risk_score", F.array_join("reasons", ",").alias("reasons")
    )
