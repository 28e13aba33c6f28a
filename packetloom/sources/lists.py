"""Blocklist text and tab-separated sensor logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources import tail

ENDPOINT_NAMES = {"id.orig_h": "orig_h", "id.orig_p": "orig_p", "id.resp_h": "resp_h", "id.resp_p": "resp_p"}


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct entries; blank lines and comments are dropped."""
    entry = F.trim(F.substring_index(F.trim("value"), "#", 1))
    return lines.select(entry.alias("value")).where(F.col("value") != "").distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


def parse_zeek(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Columns from tab-separated lines; comments and rows of another width are dropped."""
    cells = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_cells", cells)
    kept = [c for c in lines.columns if c != "value"]
    return rows.where(F.size("_cells") == len(fields)).select(
        *kept, *[F.col("_cells")[i].alias(ENDPOINT_NAMES.get(f, f)) for i, f in enumerate(fields)]
    )


def zeek_fields(lines: DataFrame) -> list[str]:
    """Column names from the first ``#fields`` line."""
    head = lines.where(F.col("value").startswith("#fields")).select("value").head()
    if head is None:
        raise ValueError("no #fields line")
    return head[0].strip().split("\t")[1:]


def _named_cells(lines: DataFrame, fields: list[str]) -> DataFrame:
    """The columns ``fields`` from rows with ``cells`` and the ``names`` of their file's header.

    A file without a header has the names ``fields``. Rows of another width are dropped.
    """
    named = lines.withColumn("names", F.coalesce("names", F.array(*map(F.lit, fields))))
    by_name = F.map_from_arrays("names", "cells")
    return named.where(F.size("cells") == F.size("names")).select(
        *[F.try_element_at(by_name, F.lit(f)).alias(ENDPOINT_NAMES.get(f, f)) for f in fields]
    )


def _header_names(line: Column) -> Column:
    cells = F.split(F.trim(line), "\t")
    return F.slice(cells, F.lit(2), F.size(cells) - 1)


def _all_names(headers: DataFrame) -> list[str]:
    """The names of all headers, in the order of their first places."""
    places = headers.select(F.posexplode(_header_names(F.col("header"))).alias("place", "name"))
    named = places.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name")
    return [r["name"] for r in named.collect()]


def _followed(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    names = F.when(F.col("fields") != "", F.split("fields", "\t"))
    return _named_cells(
        tail.follow(spark, path).select(names.alias("names"), F.split("value", "\t", -1).alias("cells")), fields
    )


def read_zeek(
    spark: SparkSession, path: str, streaming: bool = False, fields: list[str] | None = None
) -> DataFrame:
    """A log with the columns its headers name, matched by name file by file.

    Columns that a file lacks are NULL in its rows; a file without a header is read by ``fields``,
    which are the names of all headers present unless given. ``streaming`` follows the growing logs of a folder by byte
    positions, which the stream's checkpoint keeps (``tail.follow``). Large files are split in both
    forms; in a batch headers meet their lines by file.
    """
    if streaming and fields:
        return _followed(spark, path, fields)
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    headers = (
        lines.where(F.col("value").startswith("#fields")).groupBy("file")
        .agg(F.first("value").alias("header"))
    )
    fields = fields or _all_names(headers)
    if not fields:
        raise ValueError("no #fields line")
    if streaming:
        return _followed(spark, path, fields)
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return _named_cells(
        rows.join(headers, "file", "left").select(
            _header_names(F.col("header")).alias("names"), F.split("value", "\t", -1).alias("cells")
        ),
        fields,
    )
