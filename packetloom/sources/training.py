"""Training rows from CSV files and from stored vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.flows import FEATURES, clean_value, feature_array, features_from_csv

BENIGN_LABELS = ("0", "safe", "benign", "normal")  # fixed values


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_folder(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All CSV files of a folder as one table of text columns.

    Each file's own header names its columns: files are grouped by header, each group is
    one scan, and the groups are matched by trimmed name.
    """
    paths = [path] if isinstance(path, str) else sorted(path)
    firsts = (
        spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("n", F.monotonically_increasing_id()).where("file_block_start = 0")
        .groupBy("file_path").agg(F.min_by("value", "n").alias("header"))
    )
    groups = firsts.groupBy("header").agg(F.collect_list("file_path").alias("files")).orderBy("header").collect()
    parts = [trim_headers(spark.read.option("header", True).csv(sorted(g["files"]))) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def labelled_csv(df: DataFrame, strict: bool = False, map_numbers: bool = True) -> DataFrame:
    """Features and a 0/1 label. ``strict`` takes only the exact text BENIGN as 0."""
    df = trim_headers(df)
    if "Label" not in df.columns:
        raise ValueError("no Label column")
    text = F.col("Label").cast("string")
    text = text if strict else F.upper(F.trim(text))
    benign = F.coalesce(text == "BENIGN", F.lit(False))
    marked = df.withColumn("_label", F.when(benign, 0).otherwise(1)).drop("Label")
    return features_from_csv(marked, map_numbers).withColumnRenamed("_label", "label")


def read_cic(spark: SparkSession, path: str | Sequence[str], strict: bool = False) -> DataFrame:
    """S1 and S2."""
    return labelled_csv(read_csv_folder(spark, path), strict)


def binary_label(label: Column) -> Column:
    """Known benign names and 0 are 0, other numbers themselves, other text 1."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text.isin(*BENIGN_LABELS), 0).otherwise(1)


def numeric_label(label: Column) -> Column:
    """M12 for a numeric label column: truncated to an integer."""
    return label.cast("int")


def parse_vectors(df: DataFrame, col: str = "features_json") -> DataFrame:
    """S3: add ``features`` (NULL where the text is no usable vector) and ``skipped``."""
    if col not in df.columns and "features" in df.columns:
        col = "features"
    text = F.col(col).cast("string")
    # Plain numbers are read as they are. Texts with NaN, Infinity, null or quoted cells
    # are read as strings: one bad cell then spoils its vector and no other.
    quoted = F.regexp_replace(text, r"(?<=[\[,\s])(-?Infinity|NaN)(?=[\],\s])", '"$1"')
    odd = text.rlike('[NIn"tf]')
    parsed = df.withColumns(
        {
            "_plain": F.from_json(F.when(~odd, text), "array<double>"),
            "_cells": F.from_json(F.when(odd, quoted), "array<string>"),
        }
    )
    numbers = F.transform(
        "_cells", lambda c: F.when(c.isNull(), F.lit(0.0)).otherwise(c.try_cast("double"))
    )
    parsed = parsed.withColumn("_numbers", numbers)
    usable = (F.size("_numbers") > 0) & ~F.exists("_numbers", lambda x: x.isNull())
    vector = F.when(F.size("_plain") > 0, F.col("_plain")).when(
        usable, F.transform("_numbers", clean_value)
    )
    return parsed.withColumn("features", vector).withColumn(
        "skipped", F.col("features").isNull()
    ).drop("_plain", "_cells", "_numbers")


def read_training(df: DataFrame, col: str = "features_json", dim: int | None = None) -> DataFrame:
    """S3: labelled vectors (features, 0/1 label); rows that do not parse are left out."""
    parsed = parse_vectors(df, col)
    usable = ~F.col("skipped")
    if dim is not None:
        usable = usable & (F.size("features") == dim)
    # A row yields its vector or nothing. A filter would be pushed below the parsing and
    # parse every text once more per mention.
    rest = [c for c in parsed.columns if c not in ("features", "skipped")]
    rows = parsed.select(*rest, F.explode(F.when(usable, F.array("features"))).alias("features"))
    if dict(rows.dtypes)["label"] == "string":
        return rows.withColumn("label", binary_label(F.col("label")))
    return rows.withColumn("label", numeric_label(F.col("label")))


def has_rows(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def choose_training(
    csv: DataFrame | None = None, stores: dict[str, DataFrame] | None = None,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """A CSV when given, else all stores that have rows, else the fallback.

    Inputs have ``features`` and ``label``; the result names its ``source``.
    """
    def named(df: DataFrame, source: str) -> DataFrame:
        return df.select("features", "label", F.lit(source).alias("source"))

    if csv is not None:
        return named(csv, "csv")
    stores = stores or {}
    filled = [name for name, df in stores.items() if has_rows(df)]
    if filled:
        source = "+".join(filled)
        return reduce(DataFrame.unionByName, [named(stores[n], source) for n in filled])
    if has_rows(fallback):
        return named(fallback, "csv-fallback")
    empty = next((df for df in [*stores.values(), fallback] if df is not None), None)
    if empty is None:
        raise ValueError("no training source")
    return named(empty, "none").limit(0)


def seed_rows(
    labelled: DataFrame, created_at: float, max_rows: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Training rows with the vector as JSON text, the first ``max_rows`` by ``order``."""
    if max_rows is not None:
        if not order:
            raise ValueError("max_rows needs an order")
        labelled = labelled.orderBy(*order).limit(max_rows)
    return labelled.select(
        F.lit(float(created_at)).alias("created_at"),
        F.to_json(feature_array(FEATURES)).alias("features_json"),
        F.when(F.col("label") == 0, "benign").otherwise("attack").alias("label"),
    )


