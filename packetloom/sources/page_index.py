"""Q3, Q24: numbered pages of a sorted table that open only the ranges they lie in.

The rows are written once in the sort order, in files of up to some hundred thousand rows, each row with its place in
its file. A range is a run of places; the sizes table has one row a range, with the number of rows before it. A page
finds its ranges by these numbers and sorts their rows alone, however deep it lies; the places select row groups and
pages of the file. The id is the last sort key, so that a value that many rows share is cut as well.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the file number and of the place in it among the stored columns.
RANGE, PLACE = "page_range", "page_place"
#: Rows of a file, once there are more files than shuffle partitions.
FILE_ROWS = 500_000


def _keys(sort: str, order: str) -> list[Column]:
    """The order of ``logs.offset_page``: NULLs first upwards and last downwards, newest ids first among equals."""
    key = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    return [key] if sort == "id" else [key, F.col("id").desc()]


def build(rows: DataFrame, path: str, sort: str = "id", order: str = "desc", range_rows: int = 100_000) -> int:
    """Write rows under ``path`` in ranges of at most ``range_rows``; how many rows there are.

    The folder must be new: an index describes the rows as they are now. Rows need a unique id, or pages cut
    among rows of equal keys as they please.
    """
    taken = {RANGE, PLACE} & set(rows.columns)
    if taken:
        raise ValueError(f"rows have a column {min(taken)}")
    spark, keys = rows.sparkSession, _keys(sort, order)
    many = rows.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(many / FILE_ROWS))
    files = max(1, min(math.ceil(many / range_rows), tasks))
    dealt = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    # In a sorted partition this number is that of the partition, shifted by 33 bits, plus the place.
    number = F.monotonically_increasing_id()
    dealt.withColumn(PLACE, number.bitwiseAND((1 << 33) - 1)).withColumn(RANGE, F.spark_partition_id()).write.partitionBy(
        RANGE
    ).parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/shape")
    if not many:
        held = spark.range(0).select(F.col("id").cast("int").alias(RANGE), F.col("id").alias("rows"))
    else:
        held = spark.read.parquet(f"{path}/rows").groupBy(RANGE).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counted = held.withColumn("_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    cuts = F.ceil(F.col("rows") / range_rows)
    cut = counted.withColumn("_cuts", cuts).withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    first, end = (F.floor(F.col("rows") * c / F.col("_cuts")) for c in (F.col("_cut"), F.col("_cut") + 1))
    cut.select(
        RANGE, first.alias("first"), (end - first).alias("n"), (F.col("_before") + first).alias("before"),
        F.lit(sort).alias("sort"), F.lit(order).alias("order"),
    ).write.parquet(f"{path}/sizes")
    return total(spark, path)


def total(spark: SparkSession, path: str) -> int:
    """Rows in the index, from the sizes of its ranges."""
    return spark.read.parquet(f"{path}/sizes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n


def ranges(spark: SparkSession, path: str, offset: int, size: int) -> list:
    """The ranges that hold the rows from ``offset`` on, at most ``size`` of them and in order; each has a row of the page."""
    sizes = spark.read.parquet(f"{path}/sizes")
    meets = (F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset)
    return sizes.where(meets).orderBy("before").collect()


def page(spark: SparkSession, path: str, number: int = 1, size: int = 25) -> DataFrame:
    """Page ``number`` (from 1) in the order of the index, sorted; a page past the end has no rows."""
    size = max(1, int(size))
    offset = (max(1, int(number)) - 1) * size
    held = ranges(spark, path, offset, size)
    if not held:
        return spark.read.parquet(f"{path}/shape")
    shape = spark.read.parquet(f"{path}/shape").schema
    spans: dict[int, tuple[int, int]] = {}
    for r in held:  # ranges of a file follow each other
        spans[r[RANGE]] = (spans.get(r[RANGE], (r.first, 0))[0], r.first + r.n - 1)
    stored = spark.read.schema(shape.add(PLACE, "long").add(RANGE, "integer")).option("basePath", f"{path}/rows").parquet(
        *[f"{path}/rows/{RANGE}={k}" for k in spans]
    )
    wanted = [(F.col(RANGE) == k) & F.col(PLACE).between(*span) for k, span in spans.items()]
    rows = stored.where(reduce(or_, wanted)).drop(RANGE, PLACE)
    ordered = rows.orderBy(*_keys(held[0]["sort"], held[0]["order"]))
    return ordered.offset(offset - held[0]["before"]).limit(size)

