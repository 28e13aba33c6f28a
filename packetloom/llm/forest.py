"""Near duplicates by an LSH forest over MinHash signatures.

Each tree sorts all distinct shingle sets by its own eight MinHash values. Neighbours in such an
order share the longest prefixes, so they are the candidates; a region whose first value is
shared by many sets is split by the second value, and so on, until it is small. Candidates
that sizes, a sketch of the signature or counts by bins do not rule out are confirmed on the full sets:
the nearest ones as pairs, the rest inside the regions, which emit only links that join components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetloom.llm.common import WordHashes, grams, mix, only_ids, shielded, stage, texts
from packetloom.llm.graph import components

TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: A region of at most so many sets is compared whole; a larger one goes one value deeper.
REGION = 512
#: Sketches keep two bits of each value. At a similarity s they differ in 96 * (1 - s) of 128
#: values on average; at 0.75 more than 52 differ once in 10^10 pairs.
MOST_APART = 52
FAR = 2 * HASHES
#: Sets of at most so many shingles are compared within regions: 8 bytes a shingle.
LONG = 2048
#: Shingles are counted in so many bins; the smaller counts of two sets sum up to at least what they share.
BINS = 256

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSETS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_set(text: str, cache: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the text, A-Z lowered."""
    return np.unique(grams(cache.of(text.encode().lower().split()), n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of HASHES hash functions over the set, as 32 bits."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, as four 64-bit numbers: low bits, then high bits."""
    scrambled = mix(values.astype(np.uint64))
    planes = np.concatenate([(scrambled & np.uint64(1)), (scrambled >> np.uint64(1)) & np.uint64(1)])
    return np.packbits(planes.astype(np.uint8))


def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many of the values sketches (four numbers each, last axis) differ."""
    different = left ^ right
    planes = different[..., :2] | different[..., 2:]
    return np.bitwise_count(planes).sum(axis=-1, dtype=np.int64)


def bins(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each bin, a byte each; empty where a count does not fit."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (null without words), labels, sketch and bins of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sizes, keys, labels, sketches, binned = [], [], [], [], []
            for text in texts(batch):
                found = shingle_set(text, cache, words)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), labels.append(None), sketches.append(None), binned.append(None)
                    continue
                values = signature(found)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                labels.append(values.tobytes())
                sketches.append(sketch(values).tobytes())
                binned.append(bins(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary()),
                 pa.array(binned, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "labels", "sketch", "bins"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, labels binary, sketch binary, bins binary"
    )


def _of_trees(nodes: DataFrame, trees: int) -> DataFrame:
    label = F.expr(f"substring(labels, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    return nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("label", label)


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of nodes and trees in ranges of the trees' orders."""
    return (
        rows.select("tree", "label", "node", "sketch", *more)
        .repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Consecutive rows that share tree and first value, at most 16 REGION rows at a time."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[np.ndarray, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        label = np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
        tree = rows.column("tree").to_numpy(zero_copy_only=False).astype(np.int64)
        return np.column_stack([tree, label.astype(np.int64)]), rows

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys, rows = table()
        last = len(keys) - 1
        while last > 0 and (keys[last, :2] == keys[last - 1, :2]).all():
            last -= 1
        if last:
            yield keys[:last], rows.slice(0, last)
            held = [rows.slice(last)]
        elif len(keys) >= 16 * REGION:
            yield keys, rows
            held = []
    if held:
        yield table()


def _sketches(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, 4)


def neighbours(nodes: DataFrame, trees: int) -> DataFrame:
    """Candidate pairs (a, b): next to each other in a tree's order, sharing the first value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _regions(batches):
            node, marks = rows.column("node").to_numpy(), _sketches(rows)
            near = (keys[1:, :2] == keys[:-1, :2]).all(axis=1) & (apart(marks[1:], marks[:-1]) <= MOST_APART)
            at = np.flatnonzero(near)
            yield _pairs(node[at], node[at + 1])

    return _in_order(_of_trees(nodes, trees)).mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())],
        names=["a", "b"],
    )


def _small(keys: np.ndarray, depth: int = 1) -> Iterator[tuple[int, int]]:
    """Bounds of regions of at most REGION rows, each split only as deep as it must be."""
    changes = np.flatnonzero((keys[1:, : depth + 1] != keys[:-1, : depth + 1]).any(axis=1)) + 1
    edges = [0, *changes.tolist(), len(keys)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if end - begin <= REGION:
            yield begin, end
        elif depth < DEPTH:
            for b, e in _small(keys[begin:end], depth + 1):
                yield begin + b, begin + e
        else:
            for b in range(begin, end, REGION):
                yield b, min(b + REGION, end)


def _distances(
    marks: np.ndarray, group: np.ndarray, size: np.ndarray, held: list[bytes] | None, percent: int
) -> np.ndarray:
    """How far apart the sketches of a region's sets are, each against each; FAR where two are no candidates.

    That is where they are of one component or where sizes, sketches or counts by bins (``held``) rule a link out.
    """
    away = apart(marks[:, None, :], marks[None, :, :])
    least, most = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    away[(group[:, None] == group[None, :]) | (100 * least < percent * most) | (away > MOST_APART)] = FAR
    if held is not None:
        full = np.array([bool(x) for x in held])
        counts = np.frombuffer(b"".join(x or bytes(BINS) for x in held), np.uint8).reshape(-1, BINS)
        left, right = np.nonzero(np.triu(away < FAR))
        for k in range(0, len(left), 4096):
            i, j = left[k : k + 4096], right[k : k + 4096]
            room = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)
            room = np.where(full[i] & full[j], room, least[i, j])
            out = 100 * room < percent * (size[i] + size[j] - room)
            away[i[out], j[out]] = away[j[out], i[out]] = FAR
    return away


#: What to compare: rows, and the bounds of parts of them in which each row meets each other.
Parts = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, Iterator[tuple[int, int]]]]]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[int, int]]]]:
    for keys, rows in _regions(batches):
        yield rows, _small(keys)


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[int, int]]]]:
    """Consecutive rows of one pair of blocks each."""
    held: list[pa.RecordBatch] = []

    def edges(pair: np.ndarray) -> list[int]:
        return [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column("pair")[0] == batch.column("pair")[-1]:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = edges(rows.column("pair").to_numpy())[:-1]
        yield rows, zip(at, at[1:], strict=False)
        held = [rows.slice(at[-1])]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rows, iter([(0, rows.num_rows)])


def _search(
    ordered: DataFrame, percent: int, emit: Callable, schema: str | StructType, parts: Parts = _within
) -> DataFrame:
    """What ``emit(rows, distances)`` makes of each part, a small region at first, that holds several components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in parts(batches):
            marks, group = _sketches(rows), rows.column("component").to_numpy()
            size = rows.column("n_shingles").to_numpy()
            for begin, end in bounds:
                if (group[begin:end] == group[begin]).all():
                    continue
                part = rows.slice(begin, end - begin)
                held = part.column("bins").to_pylist() if "bins" in part.schema.names else None
                away = _distances(marks[begin:end], group[begin:end], size[begin:end], held, percent)
                if (away < FAR).any():
                    yield emit(part, away)

    return ordered.mapInArrow(run, schema)


def with_candidates(ordered: DataFrame, percent: int = 75, over: int = 0, parts: Parts = _within) -> DataFrame:
    """The rows of sets with more than ``over`` candidates of other components in their region of the tree.

    Components only grow and fewer rows make regions only wider, so later rounds need no other rows.
    """

    def emit(rows: pa.RecordBatch, away: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array((away < FAR).sum(axis=1) > over))

    return _search(ordered, percent, emit, ordered.schema, parts)


def across(
    ordered: DataFrame, nearest: int | None, percent: int = 75, over: int = 0, parts: Parts = _within
) -> DataFrame:
    """Candidate pairs (a, b) between the components x and y, from the small regions of all trees.

    Each set with its ``nearest`` ones (None: all); only pairs with a set of more than ``over`` shingles.
    """

    def emit(rows: pa.RecordBatch, away: np.ndarray) -> pa.RecordBatch:
        node, group, size = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        if nearest is None:
            i, j = np.nonzero(np.triu(away < FAR))
        else:
            first = np.argsort(away, axis=1, kind="stable")[:, :nearest]
            i, j = np.repeat(np.arange(len(node)), first.shape[1]), first.reshape(-1)
            near = away[i, j] < FAR
            i, j = i[near], j[near]
        large = np.maximum(size[i], size[j]) > over
        i, j = i[large], j[large]
        low = node[i] < node[j]
        i, j = np.where(low, i, j), np.where(low, j, i)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (node[i], node[j], group[i], group[j])], names=["a", "b", "x", "y"],
        )

    return _search(ordered, percent, emit, "a bigint, b bigint, x bigint, y bigint", parts).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int = 5) -> DataFrame:
    """set_key and shingles (sorted hashes) of the sets of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            held = [shingle_set(text, cache, words).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x) for x in held], pa.binary()), pa.array(held, pa.binary())],
                names=["set_key", "shingles"],
            )

    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    wanted = only_ids(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id", ids).join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "set_key binary, shingles binary").dropDuplicates(["set_key"])


def regional_links(ordered: DataFrame, percent: int = 75, parts: Parts = _within) -> DataFrame:
    """Links (x, y) between components, from full sets compared within the regions that hold them.

    All candidates of a region are tried, the nearest first, unless earlier links of the region joined
    their components already; so a region emits fewer links than it has components, and no pairs.
    """

    def emit(rows: pa.RecordBatch, away: np.ndarray) -> pa.RecordBatch:
        held = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        group = rows.column("component").to_pylist()
        least = {x: x for x in group}

        def root(x: int) -> int:
            while least[x] != x:
                least[x] = x = least[least[x]]
            return x

        links = []
        left, right = np.nonzero(np.triu(away < FAR))
        order = np.argsort(away[left, right], kind="stable")
        for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
            x, y = root(group[i]), root(group[j])
            if x == y:
                continue
            both = len(np.intersect1d(held[i], held[j], assume_unique=True))
            if 100 * both >= percent * (len(held[i]) + len(held[j]) - both):
                least[max(x, y)] = min(x, y)
                links.append((min(x, y), max(x, y)))
        return pa.RecordBatch.from_arrays(
            [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["x", "y"]
        )

    return _search(ordered, percent, emit, "x bigint, y bigint", parts).distinct()


def large_regions(nodes: DataFrame) -> DataFrame:
    """Trees and first values that more than REGION sets share; deeper values or slices keep some of these sets apart."""
    first = _of_trees(nodes.select("node", "labels"), TREES).select("tree", F.substring("label", 1, 4).alias("value"))
    return stage(first.groupBy("tree", "value").agg(F.count("*").alias("n")).where(F.col("n") > REGION).select("tree", "value"))


def block_pairs(nodes: DataFrame, found: DataFrame, regions: DataFrame, percent: int = 75) -> DataFrame:
    """pair, node and component: the sets of ``regions`` in pairs of blocks, so that all that can link meet.

    Blocks hold about REGION sets of a region, of one class of sizes, and those of a component with more
    sets than that apart; blocks of classes too far apart and blocks of one component are not paired.
    """
    step = max(float(np.log(100 / percent)), 0.01) * 1.0001
    first = _of_trees(nodes.select("node", "labels", "n_shingles"), TREES).select(
        "tree", F.substring("label", 1, 4).alias("value"), "node", F.floor(F.log("n_shingles") / step).alias("class")
    )
    members = (
        first.join(regions, ["tree", "value"]).join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    members = stage(members)
    large = (
        members.groupBy("tree", "value", "component").agg(F.count("*").alias("n"))
        .where(F.col("n") > REGION).drop("n").withColumn("large", F.lit(True))
    )
    cell = ["tree", "value", "class", "large", "one"]
    members = stage(
        members.join(large, ["tree", "value", "component"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
        .withColumn("one", F.when(F.col("large"), F.col("component")).otherwise(0))
    )
    cells = stage(members.groupBy(*cell).agg(F.ceil(F.count("*") / REGION).alias("blocks")))
    blocks = stage(
        cells.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumn("block", F.xxhash64(*cell, "k"))
    )
    other = blocks.select(
        "tree", "value", F.explode(F.array("class", F.col("class") - 1)).alias("class"), F.col("class").alias("class2"),
        F.col("large").alias("large2"), F.col("one").alias("one2"), F.col("block").alias("block2"),
    )
    pairs = (
        blocks.join(other, ["tree", "value", "class"])
        .where((F.col("class") != F.col("class2")) | (F.col("block") <= F.col("block2")))
        .where(~(F.col("large") & F.col("large2") & (F.col("one") == F.col("one2"))))
        .select(F.xxhash64("block", "block2").alias("pair"),
                F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    )
    placed = members.join(cells, cell).select(
        "node", "component", F.xxhash64(*cell, F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")
    )
    return placed.join(pairs, "block").select("pair", "node", "component")


def links_in_large(docs: DataFrame, nodes: DataFrame, found: DataFrame, percent: int = 75, words: int = 5) -> DataFrame | None:
    """Links (x, y) between components from all sets of the large regions, block against block; None without such regions.

    A task holds two blocks. Only sets with a candidate there are brought in full.
    """
    regions = large_regions(nodes)
    if regions.isEmpty():
        return None

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("pair").sortWithinPartitions("pair")

    about = nodes.select("node", "n_shingles", "sketch", "bins", "set_key")
    placed = block_pairs(nodes, found, regions, percent).join(about, "node")
    near = stage(with_candidates(together(placed), percent, parts=_by_pair))
    sets = shingle_sets(docs, near.where(F.col("n_shingles") <= LONG), words)
    links = regional_links(together(near.join(sets, "set_key")), percent, _by_pair)
    long = near.where(100 * F.col("n_shingles") >= percent * LONG)
    pairs = stage(across(together(long), None, percent, LONG, _by_pair))
    return stage(links.unionByName(confirm(pairs, docs, percent, words).select("x", "y")))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` after links (x, y) between components."""
    joined = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("target"))
    older = found.join(moved, "component", "left").select("node", F.coalesce("target", "component").alias("component"))
    newer = joined.join(found.select("node"), "node", "left_anti")
    return stage(older.unionByName(newer))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The pairs, with all their columns, whose full shingle sets share ``percent`` of their union.

    Only texts of documents in a pair are moved.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = stage(
        only_ids(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id", ends)
        .join(ends.distinct(), "doc_id", "left_semi").distinct()
    )
    left = wanted.toDF("a", "text_a")
    right = wanted.toDF("b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            held = []
            known: dict[str, np.ndarray] = {}
            for one, two in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                for text in (one, two):
                    if text not in known:
                        known[text] = shingle_set(text, cache, words)
                x, y = known[one], known[two]
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(pairs_of).filter(pa.array(held, pa.bool_()))

    pairs_of = pairs.columns
    return (
        pairs.join(left, "a").join(right, "b").select(*pairs_of, "text_a", "text_b")
        .mapInArrow(run, pairs.schema)
    )


def near_duplicates(
    docs: DataFrame, percent: int = 75, words: int = 5, first_trees: int = 3, nearest: int = 3
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Equal sets are one node, named by its smallest doc_id. Neighbours in the first trees link most
    copies. Then all trees are searched for the sets that have candidates in other components, and only
    these go on, with their counts by bins: in each small region every set is compared with all others, and
    its ``nearest`` ones in other components are confirmed; components grow, and the search is repeated
    until it links nothing more. Pairs refused so far would stand before others, so at last the sets
    that have still more candidates are brought to their regions in full and all these candidates are tried
    there; those with a set of more than ``LONG`` shingles are confirmed as pairs, for memory. Sets that share
    a first value with more than ``REGION`` others met only some of them; they meet all in pairs of blocks.
    A text without words (or null) has no shingle and no link; a row with a null id is linked
    with nothing, has component null and is kept; rows that repeat an id count as one document.
    Other columns are not read.
    """
    signed = stage(signatures(docs, words))
    nodes = stage(
        signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("node"),
             *[F.first(c).alias(c) for c in ("n_shingles", "labels", "sketch", "bins")])
    )

    def ordered(rows: DataFrame, *more: str) -> DataFrame:
        grouped = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return _in_order(grouped, "component", "n_shingles", *more)

    tried = stage(neighbours(nodes, first_trees))
    found = components(stage(confirm(tried, docs, percent, words)))
    near = with_candidates(ordered(_of_trees(nodes, TREES)), percent).drop("component")
    live = stage(near.join(nodes.select("node", "set_key", "bins"), "node"))
    while True:
        fresh = stage(across(ordered(live, "bins"), nearest, percent).join(tried, ["a", "b"], "left_anti"))
        more = stage(confirm(fresh, docs, percent, words))
        if more.isEmpty():
            break
        found = merged(found, more)
        tried = tried.union(fresh.select("a", "b"))
    # A pair not tried is not among the nearest of either end, so both have more candidates than those.
    rest = stage(with_candidates(ordered(live, "bins", "set_key"), percent, nearest).drop("component"))
    sets = shingle_sets(docs, rest.where(F.col("n_shingles") <= LONG), words)
    links = regional_links(ordered(rest.join(sets, "set_key"), "bins", "shingles"), percent)
    long = rest.where(100 * F.col("n_shingles") >= percent * LONG)
    pairs = stage(across(ordered(long, "bins"), None, percent, LONG).join(tried, ["a", "b"], "left_anti"))
    confirmed = confirm(pairs, docs, percent, words).select("x", "y")
    last = stage(links.unionByName(confirmed))
    if not last.isEmpty():
        found = merged(found, last)
    beyond = links_in_large(docs, nodes, found, percent, words)
    if beyond is not None and not beyond.isEmpty():
        found = merged(found, beyond)
    named = (
        nodes.select("set_key", "node").join(found, "node", "left")
        .select("set_key", F.coalesce("component", "node").alias("component"))
    )
    held = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return held.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The rows of ``docs``, whole, that ``near_duplicates`` keeps; equal rows of one id once."""
    hidden, restore = shielded(docs, "doc_id", "text")
    found = near_duplicates(docs, percent, words)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = hidden.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = stage(
        found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
        .where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again"))
    )
    if again.isEmpty():
        return restore(left)
    same = F.col("doc_id") == F.col("__again")
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return restore(left.join(again, same, "left_anti").unionByName(once))
