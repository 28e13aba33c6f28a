"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of every test item is looked up in all training texts and its document frequency is
counted. The rarer ones of an item are its seeds. Where a text holds seeds of an item, the passage
around them is aligned with the item word by word, so edited copies score too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import WORD, Shared, WordHashes, grams, stage, texts

#: Points for an equal word, a different word, and a word left out on either side.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Trimmed from the ends of words before they are compared.
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Items are taken in blocks of about so many n-grams, which bounds what is broadcast.
BLOCK_GRAMS = 1 << 19


def normal_words() -> WordHashes:
    """Hashes of words without case (A-Z) and edge punctuation; 0 for punctuation alone."""
    return WordHashes(prepare=lambda word: word.strip(EDGES))


def word_hashes(text: str, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that count, and the places of those words among all words."""
    found = cache.of(text.encode().lower().split())
    places = np.flatnonzero(found)
    return found[places], places


@dataclass(frozen=True)
class Items:
    """A block of items: id and word hashes by key, and the sorted seeds with key and position."""

    words: dict[int, tuple[int, np.ndarray]]
    seeds: np.ndarray
    item: np.ndarray
    position: np.ndarray

    def filter_bits(self) -> np.ndarray:
        """One byte for each value of the low 20 bits: whether any seed has it."""
        bits = np.zeros(1 << 20, bool)
        bits[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return bits


def hits(found: np.ndarray, seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of n-grams that are among the sorted seeds."""
    at = np.flatnonzero(bits[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(at) or not len(seeds):
        return at[:0]
    place = np.minimum(np.searchsorted(seeds, found[at]), len(seeds) - 1)
    return at[seeds[place] == found[at]]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: points, and begin and end of the aligned part of the passage."""
    size = len(passage)
    steps = np.arange(size + 1) * -GAP
    above, above_from = np.zeros(size + 1, np.int64), np.arange(size + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        row, origin = np.zeros(size + 1, np.int64), np.arange(size + 1)
        up = above[1:] + GAP
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin[1:] = np.where(row[1:] == 0, origin[1:], np.where(diagonal >= up, above_from[:-1], above_from[1:]))
        # Words skipped in the passage: the best of all earlier cells less a gap for each step.
        reach = row + steps
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, np.arange(size + 1), 0))
        skipped = top - steps
        better = skipped > row
        row = np.where(better, skipped, row)
        origin = np.where(better, origin[source], origin)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
        above, above_from = row, origin
    return best


def clusters(starts: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of implied item starts, each within an item's length of the next, and their number."""
    starts = np.sort(starts)
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
        yield int(part[0]), int(part[-1]), len(part)


def score_text(
    found: np.ndarray, n: int, items: Items, bits: np.ndarray, least: float
) -> list[tuple[int, float, int, int]]:
    """(item id, score, begin, end) of each item that the text holds; places count words."""
    windows = grams(found, n)
    spots = hits(windows, items.seeds, bits)
    if not len(spots):
        return []
    keys = windows[spots]
    begin, end = np.searchsorted(items.seeds, keys), np.searchsorted(items.seeds, keys, "right")
    starts: dict[int, list[int]] = defaultdict(list)
    for spot, b, e in zip(spots.tolist(), begin.tolist(), end.tolist(), strict=True):
        for k in range(b, e):
            starts[int(items.item[k])].append(spot - int(items.position[k]))
    best: dict[int, tuple[float, int, int]] = {}
    for item, at in starts.items():
        name, words = items.words[item]
        size = len(words)
        slack = size // 4 + 2
        for low, high, times in clusters(np.array(at), size):
            if times < 2 and size >= 8:
                continue
            b, e = max(0, low - slack), min(len(found), high + size + slack)
            points, begin_at, end_at = align(words, found[b:e])
            share = points / (MATCH * size)
            # A short item must be there nearly whole: a few common words are no copy.
            if share >= (least if size >= 8 else max(least, 0.95)) and share > best.get(name, (0,))[0]:
                best[name] = (share, b + begin_at, b + end_at)
    return [(name, *value) for name, value in sorted(best.items())]


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """One row per distinct item text: key, item_id, word hashes and n-gram hashes (signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = normal_words()
        for batch in batches:
            words = [word_hashes(t, cache)[0] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("item_id"),
                 pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                 pa.array([grams(w, n).view(np.int64) for w in words], pa.list_(pa.int64()))],
                names=["key", "item_id", "words", "grams"],
            )

    return (
        items.select(F.col("item_id").cast("bigint"), "text").dropna().distinct()
        .withColumn("key", F.xxhash64("item_id", "text"))
        .mapInArrow(run, "key bigint, item_id bigint, words array<bigint>, grams array<bigint>")
        .where(F.size("grams") > 0)
    )


def _frequencies(docs: DataFrame, seeds: np.ndarray, n: int) -> DataFrame:
    """(gram, docs): in how many texts each of the sorted n-grams occurs."""
    shared = Shared(docs.sparkSession, (seeds, Items({}, seeds, seeds, seeds).filter_bits()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, count = normal_words(), Counter()
        known, bits = shared.value
        for batch in batches:
            for text in texts(batch):
                found = grams(word_hashes(text, cache)[0], n)
                count.update(np.unique(found[hits(found, known, bits)]).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["gram", "docs"]
        )

    return (
        docs.select("text").mapInArrow(run, "gram bigint, docs bigint").groupBy("gram")
        .agg(F.sum("docs").alias("docs"))
    )


def _blocks(docs: DataFrame, items: DataFrame, n: int, seed_share: float) -> Iterator[Items]:
    """The test items in blocks of about BLOCK_GRAMS n-grams, with their rarer n-grams as seeds."""
    grams_of = stage(_item_grams(items, n))
    total = grams_of.agg(F.sum(F.size("grams"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_GRAMS))
    rare = Window.partitionBy("key").orderBy("docs", "position")
    for block in range(blocks):
        mine = grams_of.where(F.pmod("key", F.lit(blocks)) == block)
        places = mine.select("key", F.posexplode("grams").alias("position", "gram"))
        every = np.array([r[0] for r in places.select("gram").distinct().collect()], np.int64)
        seen = _frequencies(docs, np.sort(every.view(np.uint64)), n)
        chosen = (
            places.join(seen, "gram").withColumn("place", F.row_number().over(rare))
            .withColumn("of", F.count("*").over(Window.partitionBy("key")))
            .where(F.col("place") <= F.ceil(F.col("of") * seed_share)).select("gram", "key", "position")
        ).toPandas()
        gram = chosen["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(gram, kind="stable")
        words = {
            r["key"]: (r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in mine.collect()
        }
        yield Items(
            words, gram[order], chosen["key"].to_numpy(np.int64)[order],
            chosen["position"].to_numpy(np.int64)[order],
        )


def leaks(
    docs: DataFrame, items: DataFrame, n: int = 3, seed_share: float = 0.7, least: float = 0.5
) -> DataFrame:
    """One row per training row and test item that it holds: doc_id, item_id, score, begin, end.

    ``score`` is the share of the points that a full copy gets; ``begin`` and ``end`` bound the passage
    in code points. Seeds are the rarer ``seed_share`` of those n-grams of an item that occur in
    the texts; a passage needs two of them. An item shorter than n words is one seed; one
    without words, or with a null id or text, matches nothing, and so does a null text.
    Repeated training rows give a row each, a null doc_id stays null, other columns are not
    read. Items are broadcast in blocks of bounded size, each block against all texts.
    """
    word = re.compile(WORD)
    share = partial(Shared, docs.sparkSession)

    def search(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = normal_words()
            table, bits = shared.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    found, places = word_hashes(text, cache)
                    for item, score, begin, end in score_text(found, n, table, bits, least):
                        spans = [m.span() for m in word.finditer(text)]
                        rows.append((doc, item, score, spans[places[begin]][0], spans[places[end - 1]][1]))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(cols)],
                    names=["doc_id", "item_id", "score", "begin", "end"],
                )

        return run

    parts = [
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            search(share((table, table.filter_bits()))),
            "doc_id bigint, item_id bigint, score double, begin bigint, end bigint",
        )
        for table in _blocks(docs, items, n, seed_share)
    ]
    return reduce(DataFrame.union, parts)


def without_leaks(
    docs: DataFrame, items: DataFrame, n: int = 3, seed_share: float = 0.7, least: float = 0.5
) -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no test item (see ``leaks``); nothing is moved."""
    share = partial(Shared, docs.sparkSession)

    def clean(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = normal_words()
            table, bits = shared.value
            for batch in batches:
                free = [
                    not score_text(word_hashes(t, cache)[0], n, table, bits, least) for t in texts(batch)
                ]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    kept = docs
    for table in _blocks(docs, items, n, seed_share):
        kept = kept.mapInArrow(clean(share((table, table.filter_bits()))), docs.schema)
    return kept
