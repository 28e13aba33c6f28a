"""How filters interact when they are applied one after another.

Every part of the corpus has a posting list for each filter: the sorted ids of documents that fail it,
cut into id ranges. What a filter removes after others is the difference of its list and the union of theirs; both
come from galloping merges of the lists, range by range, and sizes add up over ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stage, texts

#: Ids of a part that are merged in one go.
RANGE = 1 << 15
_CAPITALS, _SIGNS = bytes(range(65, 91)), re.compile(r"[#$%&*|]")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, part (source, null as empty), digest of the text, and failures of filters A to D as booleans a to d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, few, repeated, loud, signs = [], [], [], [], []
            for text in texts(batch):
                plain = text.encode()
                words = plain.split()
                digests.append(hashlib.blake2b(plain, digest_size=16).digest())
                few.append(len(words) < 50)
                repeated.append(100 * len(set(words)) < 65 * len(words))
                loud.append(100 * (len(plain) - len(plain.translate(None, _CAPITALS))) > 5 * len(text))
                signs.append(_SIGNS.search(text) is not None)
            parts = [s or "" for s in batch.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(parts, pa.string()), pa.array(digests, pa.binary()),
                 *[pa.array(x, pa.bool_()) for x in (few, repeated, loud, signs)]],
                names=["doc_id", "part", "digest", "a", "b", "c", "d"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col("source").cast("string")).mapInArrow(
        run, "doc_id bigint, part string, digest binary, a boolean, b boolean, c boolean, d boolean"
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, failures of the filters as columns A to E, and the labels good and toxic.

    E fails a text that is identical to the text of any smaller doc_id; digests of 128 bits stand for texts.
    """
    marked = stage(marks(docs))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    told = (
        labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        marked.join(first.select("digest", "first"), "digest", "left").withColumn("e", again).join(told, "doc_id", "left")
        .select(
            "part", "doc_id", *[F.col(x.lower()).alias(x) for x in "ABCDE"],
            *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")],
        )
    )


def gallop(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in the sorted ``held`` where the sorted ``asked`` belong (to the left of equals).

    Steps double from the place where the first of a run of 64 belongs until all of the run are passed; a binary
    search within what was stepped over ends it.
    """
    if not len(held) or not len(asked):
        return np.zeros(len(asked), np.int64)
    low = np.repeat(np.searchsorted(held, asked[::64]), 64)[: len(asked)]
    high, step = low.copy(), 1
    while True:
        short = np.flatnonzero(high < len(held))
        short = short[held[high[short]] < asked[short]]
        if not len(short):
            break
        low[short] = high[short] + 1
        high[short] = np.minimum(high[short] + step, len(held))
        step *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = held[middle] < asked[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def within(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the sorted ids in ``asked`` are in the sorted ``held``."""
    place = gallop(held, asked)
    found = np.zeros(len(asked), bool)
    inside = place < len(held)
    found[inside] = held[place[inside]] == asked[inside]
    return found


def union(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sorted ids in either list; the shorter is galloped into the longer."""
    if len(one) < len(two):
        one, two = two, one
    place = gallop(one, two)
    new = np.ones(len(two), bool)
    inside = place < len(one)
    new[inside] = one[place[inside]] != two[inside]
    return np.insert(one, place[new], two[new])


def differences(postings: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each set of filters gone before (bits) and each filter: ids removed, good ones, toxic ones."""
    unions = [np.array([], np.int64)]
    for before in range(1, 1 << len(postings)):
        top = before.bit_length() - 1
        unions.append(union(unions[before ^ 1 << top], postings[top]))
    out = np.zeros((len(unions), len(postings), 3), np.int64)
    for before, gone in enumerate(unions):
        for k, failing in enumerate(postings):
            if not before >> k & 1:
                removed = failing[~within(failing, gone)]
                out[before, k] = len(removed), within(removed, good).sum(), within(removed, toxic).sum()
    return out


def removals(flags: DataFrame, filters: list[str]) -> DataFrame:
    """part, total, and for each filter and set of filters before it: removed, good_lost and toxic_lost.

    ``filter`` is a place in ``filters``, ``before`` has a bit for each filter gone before. Equal ids of a part are one document.
    """
    n = len(filters)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RANGE:
                rows = pa.Table.from_batches(held)
                part, ids = rows.column("part"), rows.column("doc_id")
                cut = size - 1
                while cut and (part[cut], ids[cut]) == (part[cut - 1], ids[cut - 1]):
                    cut -= 1
                yield rows.slice(0, cut)
                held, size = rows.slice(cut).to_batches(), size - cut
        if size:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows in ranges(batches):
            parts = rows.column("part").combine_chunks().dictionary_encode()
            parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
            code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            ids = rows.column("doc_id").to_numpy()
            flag = {c: rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (*filters, "good", "toxic")}
            for k, name in enumerate(names):
                mine = code == k
                postings = [np.unique(ids[mine & flag[f]]) for f in filters]
                found = differences(postings, *[np.unique(ids[mine & flag[c]]) for c in ("good", "toxic")])
                total = np.zeros((1, n, 3), np.int64)
                total[0, 0, 0] = len(np.unique(ids[mine]))
                sums[name] = sums.get(name, 0) + np.concatenate([found, total])
        for name, found in sums.items():
            flat = found.reshape(-1, 3)
            at = np.arange(len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at // n, pa.int32()), pa.array(at % n, pa.int32()),
                 *[pa.array(flat[:, c], pa.int64()) for c in range(3)]],
                names=["part", "before", "filter", "removed", "good_lost", "toxic_lost"],
            )

    columns = "part string, before int, filter int, removed bigint, good_lost bigint, toxic_lost bigint"
    known = flags.select(
        "part", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), *filters, "good", "toxic"
    )
    placed = known.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    summed = placed.mapInArrow(run, columns).groupBy("part", "before", "filter").agg(
        *[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")]
    )
    total = F.sum(F.when(F.col("before") == 1 << n, F.col("removed"))).alias("total")
    steps = F.collect_list(F.when(F.col("before") < 1 << n, F.struct("before", "filter", "removed", "good_lost", "toxic_lost")))
    # A part has one row for each pair of filter and set, so this list has a fixed length.
    return summed.groupBy("part").agg(total, steps.alias("steps")).select("part", "total", F.inline("steps"))


def interactions(flags: DataFrame, filters: str) -> DataFrame:
    """What each filter removes in every order: one row per part, order and step.

    ``flags`` has part, doc_id, a boolean column for each letter of ``filters`` (true: fails) and booleans good and toxic.
    kept, removed, redundant, unique_fails, good_lost and toxic_lost count documents of the part; shapley
    sums a filter's removals over all orders. Rows of equal part and id are one document, which fails
    what any of them fails; null ids of a part are one document. An empty table gives no rows.
    """
    n = len(filters)
    found = stage(removals(flags, list(filters)))
    spark = flags.sparkSession
    steps, times = [], {}
    for order in permutations(range(n)):
        for k, f in enumerate(order):
            before = sum(1 << x for x in order[:k])
            steps.append(("".join(filters[x] for x in order), k + 1, f, before))
            times[before, f] = times.get((before, f), 0) + 1
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    often = spark.createDataFrame([(b, f, t) for (b, f), t in times.items()], "before int, filter int, times int")
    alone = F.col("before") == F.lit((1 << n) - 1) - F.expr("shiftleft(1, filter)")
    by_filter = (
        found.join(F.broadcast(often), ["before", "filter"]).groupBy("part", "filter")
        .agg(
            F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
            F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
            F.sum(F.col("removed") * F.col("times")).alias("shapley"),
        )
    )
    # kept after a step: what is left of the total when the removals up to it are taken off.
    earlier = reduce(
        lambda a, b: a.unionByName(b),
        [plan.where(F.col("step") == k).select("filter_order", F.explode(F.sequence(F.lit(k), F.lit(n))).alias("step"), "filter", "before") for k in range(1, n + 1)],
    )
    gone = (
        found.join(F.broadcast(earlier), ["filter", "before"]).groupBy("part", "filter_order", "step")
        .agg(F.sum("removed").alias("gone"))
    )
    return (
        found.join(F.broadcast(plan), ["filter", "before"]).join(by_filter, ["part", "filter"])
        .join(gone, ["part", "filter_order", "step"])
        .select(
            "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed",
            (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
        )
    )
