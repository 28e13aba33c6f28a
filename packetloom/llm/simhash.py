"""Near duplicates by SimHash, compared bit-sliced.

Fingerprints that differ in at most ``radius`` of 64 bits agree in at least one of radius + 1
blocks of bits, so they meet in the bucket of that block. A bucket too full is cut by blocks of the bits
it does not fix, which loses no pair for the same reason. Inside a bucket fingerprints are
stored as bit planes, 64 of them a word; a query's differences from a whole word are counted
by carry-save adders, and words in which all counts exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stage, texts
from packetloom.llm.graph import components

BITS = 64
#: Fingerprints compared with each other in one go; a larger bucket is compared in tiles of two such chunks.
TILE = 4096
#: A bucket of more chunks than this is cut by further bits first, while there are any.
TILES = 16
#: How often a bucket can be cut: with radius 4 the last cut fixes 37 to 40 bits.
LEVELS = 4
#: Pairs of query and word whose counters are held at once, and planes between two looks at them.
BLOCK, GROUP = 8192, 8
#: Shingles hashed before their bits are added up.
SLICE = 1 << 16

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of the text's shingles as a signed 64-bit number; 0 without words.

    A-Z are lowered; shingles are ``words`` words joined by one space, repeats included; a shorter text is one.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    n, plain = min(words, len(tokens)), b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends, digest = (ends - sizes).tolist(), ends[n - 1 :].tolist(), xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(ends), SLICE):
        hashed = b"".join([digest(plain[b:e], 42) for b, e in zip(begins[k : k + SLICE], ends[k : k + SLICE])])
        counts += np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def cuts(radius: int, level: int) -> list[int]:
    """The bits fixed after ``level`` + 1 cuts, as masks; path p is cut into p * (radius + 1) + choice."""
    masks = [0]
    for _ in range(level + 1):
        deeper = []
        for mask in masks:
            free = [b for b in range(BITS) if not mask >> b & 1]
            for block in np.array_split(free, radius + 1):
                deeper.append(mask | sum(1 << int(b) for b in block))
        masks = deeper
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _cut(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """fp, path and key (the fixed bits) of every bucket a row of fp and path falls in at this level."""
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in cuts(radius, level)])
    path = F.explode(F.expr(f"sequence(path * {radius + 1}, path * {radius + 1} + {radius})")).alias("path")
    return rows.select("fp", path).select("fp", "path", F.col("fp").bitwiseAND(masks[F.col("path")]).alias("key"))


def buckets(prints: DataFrame, radius: int, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """level, path, key, part and fp: rows of one (level, path, key, part) are to be compared.

    ``prints`` has distinct fingerprints. Two within the radius share one such group at least; a
    group holds about 2 * ``tile`` rows at most.
    """
    ready, rows = None, prints.select("fp", F.lit(0).alias("path"))
    for level in range(LEVELS):
        placed = _cut(rows, radius, level)
        full = placed.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
        sized = stage(placed.join(full, ["path", "key"], "left"))
        deep = F.coalesce(F.col("n") > tile * tiles, F.lit(False)) if level + 1 < LEVELS else F.lit(False)
        chunks = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
        flat = (
            sized.where(~deep).withColumn("chunks", chunks)
            .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        )
        part = F.expr(
            "explode(CASE WHEN chunks = 1 THEN array(0) ELSE transform(filter(sequence(0, chunks - 1), "
            "c -> c <> mine), c -> least(c, mine) * chunks + greatest(c, mine)) END)"
        )
        flat = flat.select(F.lit(level).alias("level"), "path", "key", part.alias("part"), "fp")
        ready = flat if ready is None else ready.unionByName(flat)
        rows = sized.where(deep).select("fp", "path")
        if rows.isEmpty():
            break
    return ready


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64 values a word: row b, word w, bit k is bit b of value 64 * w + k."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS, BITS)
    packed = np.packbits(bits.transpose(2, 0, 1), axis=-1, bitorder="little")
    # One word alone keeps the order of the transposed view, whose last axis is not contiguous.
    return np.ascontiguousarray(packed).view("<u8").reshape(BITS, -1)


def _add(total: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: bits of the sum's low digit, and of the carry."""
    either = total ^ one
    return either ^ two, (total & one) | (either & two)


def _beyond(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits where the count exceeds the radius: digits are ones, twos, fours, and eight or more."""
    more, same = digits[3].copy(), ~digits[3]
    for place in (2, 1, 0):
        if radius >> place & 1:
            same = same & digits[place]
        else:
            more |= same & digits[place]
            same = same & ~digits[place]
    return more


def near_pairs(values: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of values within the radius; ``sizes`` are those of consecutive regions."""
    words = -(-sizes // BITS)
    first_word = np.cumsum(words) - words
    region = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spot = first_word[region] * BITS + inside
    padded, holder = np.zeros(int(words.sum()) * BITS, np.uint64), np.full(int(words.sum()) * BITS, -1, np.int64)
    padded[spot], holder[spot] = values, np.arange(len(values))
    filled = np.packbits((holder >= 0).reshape(-1, BITS), axis=-1, bitorder="little").view("<u8").reshape(-1)
    plane = planes(padded)
    own = spot // BITS
    later = (first_word + words)[region] - own
    before = np.cumsum(later)
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(before, (before[begin - 1] if begin else 0) + BLOCK, "right")))
        query = np.repeat(np.arange(begin, end), later[begin:end])
        shift = np.arange(len(query)) - np.repeat(np.cumsum(later[begin:end]) - later[begin:end], later[begin:end])
        word = own[query] + shift
        #: In its own word a query is compared with later values only.
        above = ~((_ONE << (spot[query] % BITS).astype(np.uint64)) * np.uint64(2) - _ONE)
        wanted = filled[word] & np.where(shift == 0, above, _ALL)
        yield from _search(values, query, word, wanted, plane, holder, radius)
        begin = end


def _search(values, query, word, wanted, plane, holder, radius) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block of (query, word) rows; ``wanted`` marks the lanes to compare."""
    live = np.flatnonzero(wanted)
    query, word, wanted = query[live], word[live], wanted[live]
    digits = [np.zeros(len(live), np.uint64) for _ in range(4)]
    asked = values[query]
    for first in range(0, BITS, GROUP):
        for b in range(first, first + GROUP, 4):
            d = [plane[b + k][word] ^ (np.uint64(0) - (asked >> np.uint64(b + k) & _ONE)) for k in range(4)]
            digits[0], two = _add(digits[0], d[0], d[1])
            digits[0], more = _add(digits[0], d[2], d[3])
            digits[1], four = _add(digits[1], two, more)
            digits[3] |= digits[2] & four
            digits[2] = digits[2] ^ four
        left = wanted & ~_beyond(digits, radius)
        live = np.flatnonzero(left)
        if not len(live):
            return
        if len(live) < 0.7 * len(left):
            query, word, wanted, asked = query[live], word[live], wanted[live], asked[live]
            digits = [x[live] for x in digits]
    left = wanted & ~_beyond(digits, radius)
    at, lane = np.nonzero(np.unpackbits(left.view(np.uint8), bitorder="little").reshape(-1, BITS))
    yield query[at], holder[word[at] * BITS + lane]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest place of each class) after linking places i and j."""
    while len(i):
        one, two = label[i], label[j]
        apart = one != two
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label = next_label
    return label


def links(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints that join what the groups' near pairs join: a star for each class of a group."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([batch.column(c).to_numpy() for c in ("level", "path", "key", "part", "fp")]))
            if sum(map(len, held)) < 4 * TILE:
                continue
            rows = np.concatenate(held)
            edges = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if len(edges):
                yield rows[: edges[-1], 4], np.diff(np.concatenate([[0], edges]))
                held = [rows[edges[-1] :]]
            else:
                held = [rows]
        if held:
            rows = np.concatenate(held)
            edges = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            yield rows[:, 4], np.diff(np.concatenate([[0], edges, [len(rows)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes in runs(batches):
            several = sizes > 1
            values = held[np.repeat(several, sizes)]
            label = np.arange(len(values))
            for i, j in near_pairs(values.view(np.uint64), sizes[several], radius):
                label = merge(label, i, j)
            at = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[label[at]]), pa.array(values[at])], names=["a", "b"])

    placed = groups.repartition("level", "path", "key", "part").sortWithinPartitions("level", "path", "key", "part", "fp")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, radius: int = 4, words: int = 4, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` (0 to 7) bits are linked; the
    component is the smallest doc_id reachable. Texts without words (or null) have the fingerprint zero
    and are linked like others. A row with a null id is linked with nothing and has component
    null; rows that repeat an id are linked each by its own text. An empty table gives no rows. Other
    columns are not read.
    """
    if not 0 <= radius <= 7:
        raise ValueError("counters hold distances up to 7")
    signed = stage(fingerprints(docs, words))
    nodes = stage(signed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    near = links(buckets(nodes, radius, tile, tiles), radius)
    named = nodes.select("fp", "node")
    ends = near.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    found = components(stage(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    held = signed.join(labels, "fp", "left")
    return held.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
