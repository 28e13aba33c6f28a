"""Q1, Q20: substring search over stored verdicts that opens few files.

For every file of a table the index holds the trigrams of its rows, read as free-text search reads them (lower
case, in JSON form). A file can hold a text only if it has all trigrams of the text; those files are read and
searched exactly. Files are indexed once, so the index follows a growing table; files without an entry are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import logs

#: Folders that the postings are dealt to by trigram.
BUCKETS = 64
#: Trigrams that a task holds before it sends them on; those it meets again are sent again.
HELD = 1_000_000


def _name(path: Column) -> Column:
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", unquote(path))


def _files(spark: SparkSession, table: str) -> list[str]:
    return sorted({_plain(f) for f in spark.read.parquet(table).inputFiles()})


def _read(spark: SparkSession, table: str, files: list[str]) -> DataFrame:
    whole = spark.read.parquet(table)
    if not files:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).option("basePath", table).parquet(*files)


def _codes(held: list[str]) -> np.ndarray:
    """The distinct trigrams of the texts, three code points of 21 bits in a number each."""
    points = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside, ends = np.ones(len(codes), bool), np.cumsum([len(t) for t in held])
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut < len(codes))]] = False
    codes = np.sort(codes[inside])
    return codes[np.diff(codes, prepend=-1) != 0]


def _texts(codes: np.ndarray) -> list[str]:
    low = np.int64(0x1FFFFF)
    whole = np.column_stack([codes >> 42, codes >> 21 & low, codes & low]).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[k : k + 3] for k in range(0, len(whole), 3)]


def _trigrams(rows: DataFrame) -> DataFrame:
    """file and gram: the distinct trigrams of the rows (file, text).

    Rows are dealt out by their texts, as files differ in size; a task sends a trigram of a file about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def grams() -> Iterator[pa.RecordBatch]:
            for name, codes in seen.items():
                found = _texts(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], names=["file", "gram"]
                )
            seen.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for name, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(name, []).append(text)
            for name, held in texts.items():
                codes = _codes(held)
                seen[name] = np.union1d(seen[name], codes) if name in seen else codes
            if sum(map(len, seen.values())) > HELD:
                yield from grams()
        yield from grams()

    return rows.repartition("file", "text").mapInArrow(run, "file string, gram string").distinct()


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _known(spark: SparkSession, index: str) -> set[str]:
    try:
        return {r.file for r in spark.read.parquet(f"{index}/files").distinct().collect()}
    except AnalysisException:
        return set()


def add_files(spark: SparkSession, table: str, index: str) -> int:
    """Index the files of the table that the index does not know; how many these were.

    Postings are written before the names of their files, so a call that failed can be repeated.
    """
    known = _known(spark, index)
    fresh = [f for f in _files(spark, table) if f not in known]
    if not fresh:
        return 0
    rows = _read(spark, table, fresh)
    whole = F.lower(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    postings = (
        _trigrams(rows.select(_name(F.input_file_name()).alias("file"), whole.alias("text")))
        .withColumn("bucket", _bucket(F.col("gram")))
    )
    postings.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy(
        "bucket"
    ).parquet(f"{index}/postings")
    spark.createDataFrame([(f,) for f in fresh], "file string").coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(fresh)


def candidate_files(spark: SparkSession, table: str, index: str, text: str) -> list[str]:
    """The files of the table that may hold a row with the text in it, without case.

    Texts of fewer than three characters may be anywhere.
    """
    wanted, present = text.lower(), _files(spark, table)
    grams = sorted({wanted[k : k + 3] for k in range(len(wanted) - 2)})
    known = _known(spark, index)
    if not grams or not known:
        return present
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket(F.col("gram")))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    postings = spark.read.schema("file string, gram string, bucket int").parquet(f"{index}/postings")
    holding = (
        postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("file")
        .agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    )
    found = {r.file for r in holding.select("file").collect()}
    return [f for f in present if f in found or f not in known]


def rows_with(spark: SparkSession, table: str, index: str, text: str) -> DataFrame:
    """The rows of the files that may hold the text in some column; a filter for the text must follow.

    Row for row this is a part of the table, and all rows with the text are in it.
    """
    return _read(spark, table, candidate_files(spark, table, index, json.dumps(text, ensure_ascii=False)[1:-1]))


def free_text(spark: SparkSession, table: str, index: str, q: str) -> DataFrame:
    """Q20 by the index: what ``logs.free_text`` finds in the whole table."""
    return logs.free_text(_read(spark, table, candidate_files(spark, table, index, q.strip())), q)
