"""Phrases that stand together more often than their parts explain.

Suffixes of pieces, cut at the longest phrase, are counted by multikey three-way quicksort: their
pointers are parted by the first word into less, equal and greater, the equal ones by the next word, and so
on; the size of an equal partition is the count of its phrase. Tasks first combine equal suffixes
of their own texts, then suffixes are routed by their leading words, so that a partition is whole in
one task and is abandoned once it is too small to hold a frequent phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import mix, stage

#: The characters that end a piece, and those that separate words within it.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"
LONGEST = 3
#: Words of text whose suffixes a task combines in one go, and words of text a bucket is meant for.
COMBINED, BUCKET_WORDS = 1 << 20, 1 << 21
#: Words are spread over several buckets if one word in so many is theirs, and fill a bucket.
SPREAD = 1 << 16
#: A text is split into words in slices of about so many bytes.
SLICE = 1 << 20

_PLAIN = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))


class Numbers(dict):
    """Numbers of words from 0 as they are asked for; -1 for an end of a piece, -2 for nothing."""

    def __init__(self) -> None:
        super().__init__({b"\n": -1, b"": -2})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) - 2
        return found

    def words(self) -> list[bytes]:
        return list(self)[2:]


def numbered(text: str, numbers: Numbers) -> np.ndarray:
    """The words of the text, A-Z lowered, as numbers; -1 between pieces and at the end."""
    plain = text.encode().lower().translate(_PLAIN)
    parts, begin = [], 0
    while begin < len(plain):
        end = plain.find(b" ", begin + SLICE)
        end = len(plain) if end < 0 else end
        words = plain[begin:end].replace(b"\n", b" \n ").split(b" ")
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        begin = end
    parts.append(np.array([-1], np.int32))
    found = np.concatenate(parts)
    return found[found > -2]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """The words seen and, for each lang, the numbered texts, for about COMBINED words at a time."""
    numbers, held, size = Numbers(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = numbered(text or "", numbers)
            held.setdefault(UNKNOWN if lang is None else lang, []).append(found)
            size += len(found)
            if size >= COMBINED:
                yield numbers.words(), {lang: np.concatenate(parts) for lang, parts in held.items()}
                numbers, held, size = Numbers(), {}, 0
    if held:
        yield numbers.words(), {lang: np.concatenate(parts) for lang, parts in held.items()}


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word) and n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, texts in _gathered(batches):
            names = pa.array(words, pa.binary()).cast(pa.string())
            for lang, found in texts.items():
                counts = np.bincount(found[found >= 0], minlength=len(words))
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), names.take(pa.array(at)), pa.array(counts[at], pa.int64())],
                    names=["lang", "phrase", "n"],
                )

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _combined(one: np.ndarray, two: np.ndarray, three: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes, a row each, and how often each occurs."""
    bits = 21
    if words >= 1 << bits:  # a text longer than what is combined in one go
        return np.unique(np.column_stack([one, two, three]), axis=0, return_counts=True)
    mask = (1 << bits) - 1
    key, n = np.unique((one << 2 * bits) | (two << bits) | (three + 1), return_counts=True)
    return np.column_stack([key >> 2 * bits, key >> bits & mask, (key & mask) - 1]), n


def _packed(words: list[bytes], rows: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """The words that rows use, and the rows with places among them for numbers (-1 stays)."""
    used, place = np.unique(rows, return_inverse=True)
    place = place.reshape(rows.shape).astype(np.int32)
    if used[0] < 0:
        used, place = used[1:], place - 1
    return b" ".join([words[k] for k in used.tolist()]), np.column_stack([place, n.astype(np.int32)]).tobytes()


def routed(docs: DataFrame, buckets: int, spread: dict[tuple[str, bytes], int]) -> DataFrame:
    """Combined suffixes as blocks: bucket, spread, lang, words and rows (three words and a count each).

    A bucket takes all suffixes with the same two leading words; if the first is in ``spread``, these
    go to so many buckets by the third word. Suffixes of one word are left out.
    """
    wide = docs.sparkSession.sparkContext.broadcast(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, texts in _gathered(batches):
            hashes = np.append(_hashes(words), np.uint64(0))
            for lang, found in texts.items():
                ended = np.concatenate([found, [-1, -1]]).astype(np.int64)
                one, two, three = ended[:-2], ended[1:-1], ended[2:]
                several = (one >= 0) & (two >= 0)
                rows, n = _combined(one[several], two[several], three[several], len(words))
                ways = np.array([wide.value.get((lang, w), 1) for w in words] or [1], np.int64)[rows[:, 0]]
                seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
                route = mix(mix(hashes[rows[:, 0]] ^ seed) + hashes[rows[:, 1]])
                route += mix(hashes[rows[:, 2]] % ways.astype(np.uint64))
                place = (route % np.uint64(buckets)).astype(np.int64) * 2 + (ways > 1)
                order = np.argsort(place, kind="stable")
                edges = np.flatnonzero(np.diff(place[order])) + 1
                blocks = [(int(place[at[0]]), *_packed(words, rows[at], n[at])) for at in np.split(order, edges) if len(at)]
                if blocks:
                    where, names, packed = zip(*blocks, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p // 2 for p in where], pa.int64()), pa.array([bool(p % 2) for p in where]),
                         pa.array([lang] * len(where), pa.string()), pa.array(names, pa.binary()), pa.array(packed, pa.binary())],
                        names=["bucket", "spread", "lang", "words", "rows"],
                    )

    return docs.select("lang", "text").mapInArrow(
        run, "bucket bigint, spread boolean, lang string, words binary, rows binary"
    )


def equal_partitions(
    keys: list[np.ndarray], sizes: np.ndarray, least: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth: the depth, a member of each equal partition, and the partition's size.

    Multikey three-way quicksort of pointers 0, 1, ... by ``keys``, one for each depth; the partitions of
    a depth are parted all at once. Pointers weigh ``sizes``. A partition lighter than ``least`` of its depth
    is abandoned, and so are suffixes that end (key -1).
    """
    at, lengths = np.arange(len(sizes)), np.array([len(sizes)] if len(sizes) else [], np.int64)
    for depth, key in enumerate(keys):
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = key[at] >= 0
        part = np.repeat(np.arange(len(lengths)), lengths)[alive]
        lengths = np.bincount(part, minlength=len(lengths))
        lengths, at = lengths[lengths > 0], at[alive]
        while len(at):
            value, begins = key[at], np.cumsum(lengths) - lengths
            ends = [value[begins], value[begins + lengths // 2], value[begins + lengths - 1]]
            pivot = np.maximum(np.minimum(ends[0], ends[1]), np.minimum(np.maximum(ends[0], ends[1]), ends[2]))
            part = np.repeat(np.arange(len(lengths)), lengths)
            middle = pivot[part]
            side = (value > middle).astype(np.int64) * 2 + (value == middle)
            slot = part * 3 + side
            weight = np.bincount(slot, weights=sizes[at], minlength=3 * len(lengths)).astype(np.int64)
            members = np.bincount(slot, minlength=3 * len(lengths))
            members[weight < least[depth]] = 0
            kept = []
            for k in range(3):
                chosen = np.flatnonzero(side == k)
                kept.append(at[chosen[members[slot[chosen]] > 0]])
            equal = members[1::3]
            there = equal > 0
            done.append((kept[1], equal[there], weight[1::3][there]))
            less, more = members[0::3], members[2::3]
            lengths = np.concatenate([less[less > 0], more[more > 0]])
            at = np.concatenate([kept[0], kept[2]])
        if not done:
            return
        at, lengths, weight = (np.concatenate(x) for x in zip(*done, strict=True))
        yield depth, at[np.cumsum(lengths) - lengths], weight


def frequent(blocks: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size and n of the phrases of two and three words counted at least ``least`` times."""

    def counted(lang: str, spread: bool, parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        rows = []
        for words, packed in parts:
            named = words.split(b" ")
            place = np.append(np.fromiter(map(numbers.__getitem__, named), np.int32, len(named)), np.int32(-1))
            block = np.frombuffer(packed, np.int32).reshape(-1, LONGEST + 1)
            rows.append(np.column_stack([place[block[:, :LONGEST]], block[:, LONGEST]]))
        held = np.concatenate(rows)
        if not spread:  # a phrase is no more frequent than its words in the bucket that has all of it
            for col in (0, 1):
                held = held[np.bincount(held[:, col], weights=held[:, LONGEST])[held[:, col]] >= least]
        bounds = [1, 1, least] if spread else [least] * LONGEST
        named = numbers.words()
        for depth, member, n in equal_partitions([held[:, k] for k in range(LONGEST)], held[:, LONGEST], bounds):
            if depth and len(member):
                found = [b" ".join([named[k] for k in row]) for row in held[member, : depth + 1].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()),
                     pa.array([depth + 1] * len(found), pa.int32()), pa.array(n, pa.int64())],
                    names=["lang", "phrase", "size", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "spread", "lang", "words", "rows")]
            for bucket, spread, lang, words, rows in zip(*cols, strict=True):
                if (bucket, spread, lang) != last:
                    if parts:
                        yield from counted(last[2], last[1], parts)
                    last, parts = (bucket, spread, lang), []
                parts.append((words, rows))
        if parts:
            yield from counted(last[2], last[1], parts)

    placed = blocks.repartition("bucket").sortWithinPartitions("bucket", "spread", "lang")
    found = placed.mapInArrow(run, "lang string, phrase string, size int, n bigint")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def counts(docs: DataFrame, least: int = 10, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of one to three words that occur ``least`` times (lang, phrase, size, n), and lang, total."""
    single = stage(word_counts(docs))
    totals = single.groupBy("lang").agg(F.sum("n").alias("total"))
    total = single.agg(F.sum("n")).first()[0] or 0
    bound = max(bucket_words, total // SPREAD)
    spread = {
        (r.lang, r.phrase.encode()): math.ceil(r.n / bucket_words)
        for r in single.where(F.col("n") > bound).collect()  # at most SPREAD rows
    }
    blocks = routed(docs, max(16, math.ceil(total / bucket_words)), spread)
    several = frequent(blocks, least)
    one = single.where(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("size"), "n")
    return stage(one.unionByName(several)), totals


def collocations(
    docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n and score.

    Texts are lowered (A-Z) and cut into pieces; a null text is empty and a null lang is ``und``.
    Candidates are phrases of two or three words that occur ``least`` times or more. Their score is the lowest over
    cuts of a * a / (l * r) in millionths, rounded down, in exact arithmetic; ties go to the first cut. A candidate within a longer
    one that is found ``cover`` percent as often at least is dropped. Rows are ranked by score, count and phrase
    (bytes). Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    known, totals = counts(docs, least, bucket_words)
    parts = known.select("lang", "phrase", "n")
    candidates = known.where("size >= 2").withColumnRenamed("n", "a")
    cut = (
        candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("tail", F.expr("substring_index(phrase, ' ', k - size)"))
        .join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    )
    score = F.expr("(CAST(1000000 AS DECIMAL(38,0)) * a * a) div (CAST(l AS DECIMAL(38,0)) * r)")
    scored = (
        cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    inner = F.expr(
        "explode(flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))"
    )
    covers = (
        candidates.where("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    left = (
        scored.join(covers, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (
        left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .join(totals, "lang")
        .select(
            "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
            F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"),
        )
    )
