"""Training, evaluation and scoring of the detection models."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.operators.flows import FEATURES
from packetloom.operators.isolation import IsolationModel, fit_isolation
from packetloom.operators.prefix import attach
from packetloom.session import use_checkpoints

MIN_SAMPLES = 100
MIN_ISOLATION_ROWS = 50
_SCORE_STEPS = 2**52


# ---- M1: scaling ----------------------------------------------------------------------


@dataclass
class Scaler:
    """Mean and population deviation per feature; a constant feature is only centred."""

    means: list[float]
    stds: list[float]

    def apply(self, features: Column) -> Column:
        return F.array(
            *[(features[i] - m) / (s or 1.0) for i, (m, s) in enumerate(zip(self.means, self.stds))]
        )


def fit_scaler(df: DataFrame, features: str = "features", dim: int = len(FEATURES)) -> Scaler:
    cells = [F.col(features)[i] for i in range(dim)]
    row = df.agg(*[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).head()
    return Scaler(list(row[:dim]), list(row[dim:]))


def scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1 on plain columns: each becomes (x - mean) / population deviation."""
    scaler = fit_scaler(df.select(F.array(*cols).alias("features")), dim=len(cols))
    scaled = scaler.apply(F.array(*cols))
    held = df.withColumn("_scaled", scaled)
    return held.withColumns({c: F.col("_scaled")[i] for i, c in enumerate(cols)}).drop("_scaled")


# ---- M4: split ------------------------------------------------------------------------


def split(
    df: DataFrame, id_col: str, label: str = "label", test: float = 0.2, seed: int = 42,
    order: Column | None = None, chunk: int = 2**51,
) -> DataFrame:
    """M4: add ``is_test`` for a fixed share of each label, the same on every run.

    Rows are ranked within their label by a hash of the id (or ``order``, an integer);
    the ranks come from running totals over hash ranges, so a label may hold most rows.
    """
    place = F.shiftright(F.xxhash64(F.col(id_col), F.lit(seed)), 1) if order is None else order
    ranked = attach(
        df.withColumn("_place", place.cast("long")), [label], "_place",
        sums={"_rank": F.lit(1).cast("long")}, tiebreak=id_col, chunk=chunk,
    )
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    joined = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn(
        "is_test", F.col("_rank") <= F.floor(F.col("_size") * test + 0.5)
    ).drop("_place", "_rank", "_label", "_size")


# ---- M5: evaluation -------------------------------------------------------------------


def class_report(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """M5: precision, recall, F1 and support per class; empty denominators give 0."""
    cells = df.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("guessed")),
                F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("guessed")),
            )
        ).alias("s"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    totals = sides.groupBy("s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"),
        (F.sum("hit") / 2).alias("hit"),
    )
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(
        F.col("guessed") + F.col("support") > 0,
        2 * F.col("hit") / (F.col("guessed") + F.col("support")),
    ).otherwise(0.0)
    return totals.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def roc_auc(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """M5: area under the ROC curve by ranks, ties counted half; NULL with one class.

    ``score`` lies in 0..1. Rows first shrink to one per distinct score.
    """
    bad = (F.col(y) == 1).cast("long")
    at = F.floor(F.col(score).cast("double") * _SCORE_STEPS).cast("long")
    by_score = df.groupBy(at.alias("at")).agg(F.sum(bad).alias("pos"), F.sum(1 - bad).alias("neg"))
    ranked = attach(
        by_score, [], "at", sums={"_below": F.col("neg")}, chunk=_SCORE_STEPS // 4096
    )
    wins = F.sum(F.col("pos") * (2 * F.col("_below") - F.col("neg")).cast("double")) / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def evaluate(
    df: DataFrame, y: str = "label", pred: str = "prediction", score: str | None = "score"
) -> DataFrame:
    """M5: accuracy, macro F1 and ROC-AUC as one row."""
    right = F.avg((F.col(y).cast("int") == F.col(pred).cast("int")).cast("int"))
    macro = class_report(df, y, pred).agg(F.avg("f1")).scalar()
    area = F.lit(None).cast("double") if score is None else roc_auc(df, y, score).scalar()
    return df.agg(right.alias("accuracy")).select(
        "accuracy", macro.alias("f1_macro"), area.alias("roc_auc")
    )


# ---- M2, M6, M10, M14: forests --------------------------------------------------------


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame | None:
    """Add ``weight`` = rows / (2 * rows of the class) for 0/1 labels; None for one class."""
    zeros, ones = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).head()
    if not zeros or not ones:
        return None
    share = F.when(F.col(label) == 1, 2.0 * ones).otherwise(2.0 * zeros)
    return df.withColumn("weight", F.lit(float(zeros + ones)) / share)


def fit_forest(
    df: DataFrame, features: str = "features", label: str = "label", trees: int = 200,
    depth: int = 15, seed: int = 42,
) -> RandomForestClassificationModel | None:
    """M2: balanced random forest on array features; None when there is one class only.

    Spark limits depth to 30, which stands in for "unlimited".
    """
    weighted = balanced_weights(df, label)
    if weighted is None:
        return None
    rows = weighted.select(
        array_to_vector(F.col(features)).alias("vector"), F.col(label).cast("double").alias("label"),
        "weight",
    )
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees,
        maxDepth=min(depth, 30), seed=seed,
    )
    return forest.fit(rows)


def attack_probability(df: DataFrame, model, features: str = "features", out: str = "rf_prob") -> DataFrame:
    """M6: probability of class 1."""
    part = model.copy({model.featuresCol: "_vector", model.predictionCol: "", model.rawPredictionCol: "",
                       model.probabilityCol: "_probability"})
    held = part.transform(df.withColumn("_vector", array_to_vector(F.col(features))))
    return held.withColumn(out, vector_to_array("_probability")[1]).drop("_vector", "_probability")


def combine_forests(df: DataFrame, models: list, features: str = "features", out: str = "rf_prob") -> DataFrame:
    """Mean probability of several forests, weighted by their trees."""
    parts = [f"_{out}{i}" for i in range(len(models))]
    for name, model in zip(parts, models):
        df = attack_probability(df, model, features, name)
    trees = [m.getNumTrees for m in models]
    mean = sum((F.col(p) * t for p, t in zip(parts, trees)), F.lit(0.0)) / sum(trees)
    return df.withColumn(out, mean).drop(*parts)


@dataclass
class Models:
    """What scoring needs: scaler, forests (M14 keeps the old ones) and anomaly model."""

    scaler: Scaler
    forests: list = field(default_factory=list)
    isolation: IsolationModel | None = None
    only_class: int = 0

    @property
    def has_iso(self) -> bool:
        return self.isolation is not None

    @property
    def trusted(self) -> bool:
        """The forest has seen both classes and there is an anomaly model."""
        return bool(self.forests) and self.has_iso

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add rf_prob, rf_pred, iso_raw and iso_pred."""
        held = df.withColumn("_scaled", self.scaler.apply(F.col(features)))
        if self.forests:
            held = combine_forests(held, self.forests, "_scaled")
            held = held.withColumn("rf_pred", (F.col("rf_prob") > 0.5).cast("int"))
        else:
            held = held.withColumns({"rf_prob": F.lit(0.0), "rf_pred": F.lit(self.only_class)})
        if self.has_iso:
            held = self.isolation.transform(held, "_scaled")
        else:
            held = held.withColumns({"iso_raw": F.lit(0.0), "iso_pred": F.lit(1)})
        return held.drop("_scaled")


# ---- M13, M15: retraining -------------------------------------------------------------


def preview(df: DataFrame, dim: int = len(FEATURES), min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row per class from parsed rows (features, skipped, label): counts and readiness."""
    good = ~F.col("skipped")
    size = F.when(good, F.size("features"))
    # One pass: the parsing costs most, and what all rows have in common follows from one row per class.
    by_label = df.groupBy("label").agg(
        F.count_if(good).alias("samples"), F.count_if(~good).alias("bad"),
        F.min(size).alias("low"), F.max(size).alias("high"),
    )
    every = Window.partitionBy(F.lit(0))
    low, high = F.min("low").over(every), F.max("high").over(every)
    return by_label.select(
        "label", "samples", high.alias("feature_dim"), F.sum("bad").over(every).alias("skipped_rows"),
        ((F.sum("samples").over(every) >= min_samples) & (low == dim) & (high == dim)).alias("ready"),
    ).where(F.col("samples") > 0)


def retrain(
    df: DataFrame, id_col: str, previous: Models | None = None, min_samples: int = MIN_SAMPLES,
    dim: int = len(FEATURES), test: float = 0.2, trees: int = 300, depth: int = 30,
    extra_trees: int = 100, isolation_trees: int = 200, contamination: float = 0.02,
    seed: int = 42,
) -> tuple[Models, DataFrame] | None:
    """Split, scale, fit and evaluate; the models and a one-row result, or None.

    With ``previous`` its forests stay and ``extra_trees`` new trees join them (M14). New
    trees need the scaling of the old ones, so the scaler stays too.
    """
    total, fitting = df.agg(F.count("*"), F.count_if(F.size("features") == dim)).head()
    if total < min_samples or fitting != total:
        return None
    # Fitting and evaluation read the split about ten times.
    use_checkpoints(df.sparkSession)
    marked = split(df, id_col, test=test, seed=seed).checkpoint()
    train, held_out = marked.where(~F.col("is_test")), marked.where("is_test")
    scaler = previous.scaler if previous and previous.forests else fit_scaler(train, dim=dim)
    scaled = train.withColumn("features", scaler.apply(F.col("features")))
    extending = bool(previous and previous.forests)
    new = fit_forest(scaled, trees=extra_trees if extending else trees, depth=depth, seed=seed)
    normal = scaled.where(F.col("label") == 0)
    isolation = fit_isolation(
        normal, id_col, trees=isolation_trees, contamination=contamination, seed=seed,
        min_rows=MIN_ISOLATION_ROWS,
    )
    if isolation is None and previous is not None:
        isolation = previous.isolation
    forests = ([*previous.forests] if extending else []) + ([new] if new is not None else [])
    only = 0 if new is not None else int(train.agg(F.max("label")).head()[0])
    models = Models(scaler, forests, isolation, only)
    guessed = models.predict(held_out)
    result = evaluate(guessed, pred="rf_pred", score="rf_prob").select(
        F.lit(total).alias("samples"), "*",
        train.agg(F.count("*")).scalar().alias("train_rows"),
        held_out.agg(F.count("*")).scalar().alias("test_rows"),
        F.lit(isolation is not None).alias("has_iso"), F.lit(extending).alias("incremental"),
    )
    return models, result


# ---- S12: artefacts -------------------------------------------------------------------


def save(models: Models, spark: SparkSession, path: str, created_at: float) -> str:
    """Write a new version, then point to it; readers never see a half-written one."""
    version = uuid.uuid4().hex
    base = f"{path}/versions/{version}"
    for i, forest in enumerate(models.forests):
        forest.write().save(f"{base}/forest-{i}")
    if models.isolation is not None:
        spark.createDataFrame(models.isolation.nodes).write.parquet(f"{base}/isolation")
    about = {
        "means": models.scaler.means, "stds": models.scaler.stds, "forests": len(models.forests),
        "only_class": models.only_class, "features": FEATURES,
        "isolation": None if models.isolation is None
        else [models.isolation.sample_size, models.isolation.offset],
    }
    pointer = [(float(created_at), version, json.dumps(about))]
    spark.createDataFrame(pointer, "created_at double, version string, about string").write.mode(
        "append"
    ).parquet(f"{path}/pointer")
    return version


def load(spark: SparkSession, path: str) -> Models:
    """The newest version."""
    row = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("created_at")).head()
    about, base = json.loads(row.about), f"{path}/versions/{row.version}"
    models = Models(
        Scaler(about["means"], about["stds"]),
        [RandomForestClassificationModel.load(f"{base}/forest-{i}") for i in range(about["forests"])],
        None, about["only_class"],
    )
    if about["isolation"]:
        size, offset = about["isolation"]
        nodes = spark.read.parquet(f"{base}/isolation").toPandas()
        models = replace(models, isolation=IsolationModel(nodes, size, offset))
    return models
