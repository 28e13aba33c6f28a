"""Best-fit packing of token sequences by bin completion.

Documents are tokenised and cut in tasks. Which document lies where follows from lengths alone, so
the search runs on the number of pieces of each length, at most as many numbers as a sequence has
tokens, and gives fillings with multiplicities. Spark ranks the pieces of a length and
reads a piece's place from its rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stage, texts

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name among the installed public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """The ids that a tokenizers file gives a string, without added special tokens.

    A byte-level BPE whose merges are numbered in their order is a table of ranks; such a
    table is merged several times faster elsewhere. Other files, and strings that hold a
    special token, go through tokenizers itself, which is loaded when it is needed.
    """

    def __init__(self, path: str) -> None:
        self.path, self.loaded, self.fast = path, None, None
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, model = parts.get("pre_tokenizer") or {}, parts["model"]
        merges = model.get("merges") or []
        vocab = model.get("vocab") or {}
        numbers = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        simple = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not parts.get("normalizer") and not parts.get("post_processor") and merges
            and None not in numbers and numbers == sorted(numbers)
        )
        if not simple:
            return
        import tiktoken

        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks.get(b"\n", -1)
        self.other_space = re.compile(r"[^\S \n]")

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded.encode(text, add_special_tokens=False).ids

    def spaced(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, each behind a space, in a row, and how many each has.

        Chunks without line ends and outer white space are encoded as the lines of one string: a
        line end before a space is cut off by itself and has an id that no such chunk holds.
        """
        lines = self._lines(chunks)
        if lines is None:
            codes = [self(" " + chunk) for chunk in chunks]
            sizes = np.fromiter(map(len, codes), np.int64, len(codes))
            return np.fromiter(chain.from_iterable(codes), np.uint32, int(sizes.sum())), sizes
        return lines

    def _plain(self, joined: str, chunks: list[str]) -> bool:
        """Whether chunks joined by a line end and a space hold no white space of their own, no special token and are not empty."""
        between = len(chunks) - 1
        return (
            all(chunks) and joined.count("\n") == between and joined.count(" ") == between
            and self.other_space.search(joined) is None and not any(s in joined for s in self.special)
        )

    def _lines(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        if self.fast is None or self.line_end < 0 or len(chunks) < 2:
            return None
        joined = "\n ".join(chunks)
        # One look at all chunks; only if white space or a special token is among them, one at each.
        hard = [] if self._plain(joined, chunks) else [
            k for k, c in enumerate(chunks)
            if not c or "\n" in c or c[0].isspace() or c[-1].isspace() or any(s in c for s in self.special)
        ]
        if hard:
            easy = np.ones(len(chunks), bool)
            easy[hard] = False
            places = np.flatnonzero(easy)
            lines = self._lines([chunks[k] for k in places])
            if lines is None:
                return None
            codes = [self(" " + chunks[k]) for k in hard]
            sizes = np.zeros(len(chunks), np.int64)
            sizes[places], sizes[hard] = lines[1], list(map(len, codes))
            of_easy = np.repeat(easy, sizes)
            flat = np.empty(len(of_easy), np.uint32)
            flat[of_easy] = lines[0]
            flat[~of_easy] = np.fromiter(chain.from_iterable(codes), np.uint32, len(flat) - len(lines[0]))
            return flat, sizes
        ids = np.array(self.fast.encode_ordinary(" " + joined), np.uint32)
        cuts = np.flatnonzero(ids == self.line_end)
        if len(cuts) != len(chunks) - 1:
            return None
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), sizes


class Numbers(dict):
    """A number for each chunk, in the order of first sight; ``new`` lists those not yet learned."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class ChunkIds:
    """Token ids of texts, chunk by chunk, remembering those of the first ``limit`` chunks.

    A text is cut at each space that stands between two characters that are no white space; the
    space goes to the chunk behind. Byte-level cutting never spans such a place, and what
    follows does not depend on what precedes, so ids of chunks in a row are the ids of the
    text. Chunks beyond the limit are remembered for their batch only.
    """

    def __init__(self, path: str, limit: int = 600_000) -> None:
        self.encode = Encoder(tokenizer_path(path))
        self.limit = limit
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.rare = re.compile(r"[^\S \n]")
        self.number = Numbers()
        self.flat = np.empty(1 << 20, np.uint32)
        self.begin, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = self.learned = 0

    def numbers(self, chunks: Iterable[str], count: int) -> tuple[np.ndarray, list[str]]:
        """The number of each chunk, and the chunks that are new, whose numbers are the last ones."""
        at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, count)
        new, self.number.new = self.number.new, []
        if new:
            codes, sizes = self.encode.spaced(new)
            end, total = self.learned + len(new), self.used + len(codes)
            while len(self.begin) < end:
                self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
            while len(self.flat) < total:
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.begin[self.learned : end] = np.cumsum(sizes) - sizes + self.used
            self.size[self.learned : end] = sizes
            self.flat[self.used : total] = codes
            self.learned, self.used = end, total
        return at, new

    def forget(self, new: list[str]) -> bool:
        """Drop the newest chunks if there are more than ``limit``; whether they were dropped."""
        if len(self.number) <= self.limit or not new:
            return False
        for chunk in new:
            del self.number[chunk]
        self.learned -= len(new)
        self.used = int(self.begin[self.learned])
        return True

    def of(self, at: np.ndarray) -> np.ndarray:
        """Ids of numbered chunks in a row, each behind a space."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begin[at] - (ends - size), size) + np.arange(total)]

    def batch(self, lists: list[list[str]]) -> Iterator[np.ndarray]:
        """Ids of each list of chunks, each behind a space; new chunks are tokenised once."""
        ends = np.cumsum([len(chunks) for chunks in lists]).astype(np.int64)
        at, new = self.numbers(chain.from_iterable(lists), int(ends[-1]) if lists else 0)
        for chunks, end in zip(lists, ends.tolist(), strict=True):
            yield self.of(at[end - len(chunks) : end])
        self.forget(new)

    def texts(self, texts: list[str], at_once: int = 200) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for k in range(0, len(texts), at_once):
            # Cuts beside other white space are not safe; such texts are cut with more care.
            cut = [self.cut.split(t) if self._unsafe(t) else t.split(" ") for t in texts[k : k + at_once]]
            for parts, ids in zip(cut, self.batch([p[1:] for p in cut]), strict=True):
                yield np.concatenate([np.array(self.encode(parts[0]), np.uint32), ids])

    def _unsafe(self, text: str) -> bool:
        """Whether a space may stand beside white space or an end of the text."""
        return bool(text) and (
            text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text
            or self.rare.search(text) is not None
        )


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row.

    A document is its ids and the id ``end``. A longer one than ``capacity`` is cut into full
    pieces, the first taking what is left over. Empty and null texts are the end alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkIds(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            docs_of = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs_of, coder.texts(texts(batch)), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, b, e - b, zlib.crc32(ids[b:e].tobytes())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


@dataclass
class Plan:
    """Fillings in the order of their sequences: (lengths with repeats, how often)."""

    fillings: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.fillings)


def _best(room: int, counts: np.ndarray, fits: np.ndarray, largest: int) -> tuple[int, ...]:
    """Best fit: the longest that fits, again and again."""
    out: list[int] = []
    while room > 0:
        size = int(fits[min(room, largest)])
        while size and counts[size] <= out.count(size):
            size = int(fits[size - 1])
        if not size:
            break
        out.append(size)
        room -= size
    return tuple(out)


def completions(room: int, counts: np.ndarray, most: int = 4, wide: int = 48) -> list[tuple[int, ...]]:
    """Some promising fillings of ``room`` with the lengths at hand, least waste first; ``undominated`` has all.

    The best-fit filling is the incumbent. For each length in the filling's first place the best
    partner is read from a table of what fits; where that wastes room, the ``wide`` longest
    are each tried with all second lengths. Waste bounds end the search: no deeper filling is
    tried once one without waste is known. Every filling is topped up by best fit, so none
    has room for one more length: a filling that has is dominated by it.
    """
    counts = counts[: room + 1]
    sizes = np.flatnonzero(counts)[::-1]
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [()]
    fits = np.maximum.accumulate(np.where(counts > 0, np.arange(room + 1), 0))
    found = {_best(room, counts, fits, room)}

    def pair(first: np.ndarray, left: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The longest second length for each first one, not longer than it."""
        second = fits[np.minimum(left, first)]
        short = (second == first) & (used[first] < 2)
        return np.where(short, fits[np.minimum(left, first - 1)], second)

    def keep(filling: tuple[int, ...]) -> None:
        after = counts.copy()
        np.subtract.at(after, list(filling), 1)
        rest = room - sum(filling)
        if rest >= sizes[-1] and (after[: rest + 1] > 0).any():
            filling = (*filling, *_best(rest, after, np.maximum.accumulate(
                np.where(after > 0, np.arange(room + 1), 0)), rest))
        found.add(tuple(sorted(filling, reverse=True)))

    def waste() -> int:
        return min(room - sum(f) for f in found)

    second = pair(sizes, room - sizes, counts)
    left = room - sizes - second
    for k in np.argsort(left, kind="stable")[:most]:
        keep(tuple(int(x) for x in (sizes[k], second[k]) if x))
    if waste():
        for first in sizes[:wide].tolist():
            counts[first] -= 1
            others = sizes[(sizes <= min(first, room - first)) & (counts[sizes] > 0)]
            if len(others):
                third = pair(others, room - first - others, counts)
                k = int((room - first - others - third).argmin())
                best = tuple(int(x) for x in (first, others[k], third[k]) if x)
                counts[first] += 1
                keep(best)
            else:
                counts[first] += 1
            if not waste():
                break
    return sorted(found, key=lambda f: (room - sum(f), len(f), f))[:most]


def dominated(filling: tuple[int, ...], rest: int, after: np.ndarray) -> bool:
    """Whether a length left over (``after``: counts) could take the place of one or two of the filling.

    It is then at least as long as what it replaces, which fits wherever the length lies in any packing.
    """
    sizes = sorted(set(filling))
    for k, size in enumerate(sizes):
        if after[size + 1 : size + rest + 1].any():
            return True
        for other in sizes[k:]:
            if (other != size or filling.count(size) > 1) and after[size + other : size + other + rest + 1].any():
                return True
    return False


def undominated(room: int, counts: np.ndarray, left: list[int]) -> Iterator[tuple[int, ...]]:
    """All fillings of ``room`` that take no further length and are not ``dominated``, longest lengths first.

    Each leaf, given out or not, takes one from ``left``; at zero the enumeration ends.
    """
    after = counts.copy()
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    chosen: list[int] = []

    def fill(first: int, rest: int) -> Iterator[tuple[int, ...]]:
        leaf = True
        for k in range(first, len(sizes)):
            size = sizes[k]
            if size <= rest and after[size]:
                leaf = False
                chosen.append(size)
                after[size] -= 1
                yield from fill(k, rest - size)
                after[size] += 1
                chosen.pop()
            if left[0] <= 0:
                return
        if leaf:
            left[0] -= 1
            if not after[1 : rest + 1].any() and not dominated(tuple(chosen), rest, after):
                yield tuple(chosen)

    yield from fill(0, room)


def bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences.

    For every cut-off k: lengths over capacity - k take a sequence each, so do those over
    half, and what lengths from k up do not find beside the latter needs room of its own.
    """
    number, volume = np.cumsum(counts), np.cumsum(np.arange(len(counts)) * counts)
    best, half = -(-int(volume[-1]) // capacity), capacity // 2
    if not half:
        return max(best, int(number[-1] - number[0]))
    k = np.arange(1, half + 1)
    huge, large = number[-1] - number[capacity - k], number[capacity - k] - number[half]
    over = volume[half] - volume[k - 1] - (large * capacity - (volume[capacity - k] - volume[half]))
    return max(best, int((huge + large + np.maximum(0, -(-over // capacity))).max()))


def ways(counts: np.ndarray, capacity: int, left: list[int]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings around the longest length at hand and how often each is used: as often as lengths last, or once.

    The promising ones of ``completions`` come first, then all others that are undominated.
    """
    large = int(np.flatnonzero(counts)[-1])
    counts = counts.copy()
    counts[large] -= 1
    first = completions(capacity - large, counts.copy())
    seen = set(first)
    for rest in chain(first, (f for f in undominated(capacity - large, counts, left) if f not in seen)):
        filling = (large, *rest)
        most = min(int(counts[s] + (s == large)) // n for s, n in Counter(filling).items())
        yield filling, most
        if most > 1:
            yield filling, 1


def greedy(counts: np.ndarray, capacity: int, fill: Callable[[int, np.ndarray], tuple[int, ...]]) -> Plan:
    """The packing that fills around the longest length left with ``fill``, each time as often as lengths last."""
    counts = counts.copy()
    fillings: list[tuple[tuple[int, ...], int]] = []
    while counts.any():
        large = int(np.flatnonzero(counts)[-1])
        counts[large] -= 1
        filling = (large, *fill(capacity - large, counts))
        counts[large] += 1
        need = Counter(filling)
        times = min(int(counts[s]) // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
        fillings.append((filling, times))
    return Plan(fillings)


def best_fit(room: int, counts: np.ndarray) -> tuple[int, ...]:
    """Best fit for ``room`` from the lengths at hand."""
    fits = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
    return _best(room, counts, fits, room)


def solve(counts: np.ndarray, capacity: int = CAPACITY, budget: int = 8_000) -> Plan:
    """Branch and bound over fillings; ``counts[n]`` is the number of pieces of length n.

    Best fit and the best completions are the first incumbents. Depth first, a node fills sequences
    around the longest length left, in all undominated ways; a branch is pruned where its sequences and
    the lower bound of what is left (by volume and by lengths that cannot share) do not beat the
    incumbent. The search ends when the incumbent meets the lower bound, when nothing is left to try, or
    after ``budget`` nodes and leaves; then the incumbent may be above the optimum by at most its
    distance to ``bound``.
    """
    least = bound(counts, capacity)
    best = min(
        (greedy(counts, capacity, fill) for fill in (best_fit, lambda room, held: completions(room, held.copy())[0])),
        key=lambda plan: plan.sequences,
    )
    counts, left, used = counts.copy(), [budget], 0
    path: list[tuple[tuple[int, ...], int]] = []

    def take(filling: tuple[int, ...], times: int) -> None:
        for s in filling:
            counts[s] -= times

    nodes = [ways(counts, capacity, left)] if counts.any() else []
    while nodes and left[0] > 0 and best.sequences > least:
        step = next(nodes[-1], None)
        if step is None:
            nodes.pop()
            if path:
                filling, times = path.pop()
                take(filling, -times)
                used -= times
            continue
        filling, times = step
        left[0] -= 1
        take(filling, times)
        if used + times + bound(counts, capacity) >= best.sequences:
            take(filling, -times)
        elif not counts.any():
            best = Plan([*path, step])
            take(filling, -times)
        else:
            path.append(step)
            used += times
            nodes.append(ways(counts, capacity, left))
    return best


def places(plan: Plan) -> tuple[np.ndarray, ...]:
    """By length and rank among pieces of that length: first rank of each run, copies per
    sequence, first sequence and first offset; sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan.fillings:
        offset = 0
        for size in dict.fromkeys(filling):
            copies = filling.count(size)
            rank = taken.get(size, 0)
            rows.append((size, rank, copies, sequence, offset))
            taken[size] = rank + copies * times
            offset += copies * size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def ranked(found: DataFrame, salts: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, without gathering a length.

    A length is dealt over ``salts`` parts by a hash of the piece; a part ranks its own and
    starts after all parts before it.
    """
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return (
        salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("own")).drop("salt", "own", "first")
    )


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, budget: int = 8_000) -> DataFrame:
    """The pieces of all rows with sequence_id and offset.

    Repeated rows are pieces of their own; a null doc_id stays null; an empty table packs
    into nothing. Only lengths and their counts reach the driver.
    """
    spark = docs.sparkSession
    found = stage(pieces(docs, tokenizer, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[length] = n
    shared = spark.sparkContext.broadcast(places(solve(counts, capacity, budget)))
    salts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, copies, sequence, offset = shared.value
        key = size << 40 | rank
        for batch in batches:
            length = batch.column("length").to_numpy()
            own = batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 40 | own, "right") - 1
            past = own - rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + past // copies[at], pa.int64()),
                 pa.array(offset[at] + past % copies[at] * length, pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked(found, salts).select(*names, "rank").mapInArrow(
        run,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
