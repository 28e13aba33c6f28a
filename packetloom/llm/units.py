"""Repeated lines and their sentences, or paragraphs: digests of normalised units, grouped over all documents.

The earliest occurrence by (doc_id, place) stays, every later one is removed. Spans are code
points of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.alignment import EDGES
from packetloom.llm.common import stage, texts

#: A sentence ends at one of these marks with space behind it.
_SENTENCE = re.compile(r"[^\x20\t\x0b-\r].*?(?:[.!?。！？][\"'»”’)\]]*(?=[\x20\t\x0b-\r]|\Z)|\Z)", re.DOTALL)
_PARAGRAPH = re.compile(r"(?:[^\n]*[^\n\x20\x09\x0B-\x0D][^\n]*(?:\n|\Z))+")


def cut(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Spans of lines, or of paragraphs (lines with words in a row)."""
    if unit == "paragraph":
        for match in _PARAGRAPH.finditer(text):
            yield match.start(), match.end() - match[0].endswith("\n")
        return
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def sentences(line: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a line, without the spaces between them."""
    return [match.span() for match in _SENTENCE.finditer(line)]


def normal_form(piece: str) -> list[bytes]:
    """Words without case (A-Z) and edge punctuation; punctuation alone is dropped."""
    return [w for w in (word.strip(EDGES) for word in piece.encode().lower().split()) if w]


def occurrences(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, begin, end, n_words and a 128-bit digest of each unit of ``min_words`` or more.

    Lines of several sentences are followed by these as units of their own; ``line`` is where the
    line of such a sentence begins, and null for all other units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, begins, ends, sizes, digests, lines = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                for begin, end in cut(text, unit):
                    spans = [(begin, end, None)]
                    parts = sentences(text[begin:end]) if unit == "line" else []
                    if len(parts) > 1:
                        spans += [(begin + b, begin + e, begin) for b, e in parts]
                    for b, e, line in spans:
                        words = normal_form(text[b:e])
                        if len(words) >= min_words:
                            docs_of.append(doc), begins.append(b), ends.append(e), sizes.append(len(words))
                            digests.append(xxhash.xxh3_128_digest(b" ".join(words))), lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_of, pa.int64()), pa.array(np.array(begins, np.int64)), pa.array(np.array(ends, np.int64)),
                 pa.array(np.array(sizes, np.int64)), pa.array(digests, pa.binary()), pa.array(lines, pa.int64())],
                names=["doc_id", "begin", "end", "n_words", "digest", "line"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, begin bigint, end bigint, n_words bigint, digest binary, line bigint"
    )


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 1, sure: int = 8, several: int = 3) -> DataFrame:
    """One row per unit to remove: doc_id, begin, end, n_words, first_doc_id, first_begin.

    The first occurrence is the one with the smallest (doc_id, begin), null ids before all
    others. Rows that repeat both are one occurrence. Units with fewer words stay (by default
    only those without a word), and so do empty and null texts. Sentences of a line are units
    too, unless the whole line is removed; one of fewer than ``sure`` words only where the same words
    stand in ``several`` documents, for a short one can come twice by chance.
    """
    found = occurrences(docs, unit, min_words)
    place = F.struct("doc_id", "begin")
    # Staged, so that the join below is one of its own and Spark can split a frequent digest.
    first = stage(
        found.groupBy("digest", "doc_id").agg(F.min("begin").alias("begin"), F.count("*").alias("n"))
        .groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("n"), F.count("*").alias("documents"))
        .where("n > 1").select("digest", "first", "documents")
    )
    told = F.col("line").isNull() | (F.col("n_words") >= sure) | (F.col("documents") >= several)
    gone = found.join(first, "digest").where(~place.eqNullSafe(F.col("first")) & told).select(
        "doc_id", "begin", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.begin").alias("first_begin"), "line",
    )
    if unit != "line":
        return gone.drop("line")
    gone = stage(gone)
    whole = gone.where("line IS NULL").select(F.col("doc_id").alias("__id"), F.col("begin").alias("__line")).distinct()
    inside = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("line") == F.col("__line"))
    single = gone.where("line IS NOT NULL").join(whole, inside, "left_anti")
    return gone.where("line IS NULL").unionByName(single).drop("line")


def without_repeats(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, and the removed spans beside it.

    ``removed`` holds begin and end in the original text. The line end after a removed line goes with
    it, and the space after a removed sentence. A document of which nothing is left has the
    text ''. Rows that share an id share their removals, so ids should be unique.
    """
    gone = (
        repeats(docs, unit, min_words).groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("removed"))
        .withColumnRenamed("doc_id", "__id")
    )
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    held = (
        docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left").drop("__id")
        .withColumn("removed", F.coalesce("removed", none))
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("text")

    def part(begin: F.Column, end: F.Column) -> F.Column:
        return F.substring(text, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def after(s: F.Column) -> F.Column:
        """Where the text goes on: behind the space, and behind the line end if no more of the line is before it."""
        mark = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        alone = (s["begin"] == 0) | (F.substring(text, s["begin"].cast("int"), F.lit(1)) == "\n")
        skip = (mark == " ") | ((mark == "\n") & alone)
        return s["end"] + F.when(skip, F.lit(1)).otherwise(F.lit(0))

    left = F.aggregate(
        "removed", start,
        lambda done, s: F.struct(
            F.concat(done["out"], part(done["at"], s["begin"])).alias("out"),
            F.least(after(s), F.length(text).cast("bigint")).alias("at"),
        ),
        lambda done: F.concat(done["out"], part(done["at"], F.length(text).cast("bigint"))),
    )
    return held.withColumn("text", F.when(F.size("removed") > 0, left).otherwise(text))
