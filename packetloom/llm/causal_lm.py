"""Log probabilities of whole texts under a small causal self-attention model.

Words of all training documents are counted in Spark; from these counts come the add-one base,
the counts of subword ids and their classes. A one-head attention model over embeddings of
subword ids, trained in numpy, predicts the class of the next id; the id within its class
has its share of the counts. Weights start from a sample; then tasks compute the gradients of their
own windows over the whole table and Spark adds them up. Texts are scored in overlapping windows, each token once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import Shared, bounded_sample, fold, sliced, stage, stage_by, texts
from packetloom.llm.packing import TOKENIZER, ChunkIds, Encoder, tokenizer_path

#: The token after the words of a text; no word, for it holds a space.
END = " end"
_SPREAD = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Chunks of text whose ids a task remembers.
CHUNKS = 200_000
#: Slices of the texts, each a step of a pass.
SLICES = 16
#: Windows whose gradients are taken at once; what they need stays in a core's cache.
BLOCK = 63
#: Windows of a call: whole blocks, so that the arrays of a block are held throughout.
CALL = 32 * BLOCK
LN10 = float(np.log(10))


def word_list(text: str) -> list[str]:
    """Words with A-Z lowered, split at space and \\x09-\\x0D."""
    return [w for w in text.encode().lower().translate(_SPREAD).decode().split(" ") if w]


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) >> 1


def strings(words: pa.Array) -> list[str]:
    """A column without nulls as strings; by way of numpy, several times as fast as one value after the other."""
    return words.to_numpy(zero_copy_only=False).tolist()


def word_counts(docs: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(hash, word, n) over all texts, the end of each counted as a token.

    Tasks count about ``flush`` words at a time before Spark adds the counts up.
    """

    def rows(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
        hashes = pa.array(list(map(word_hash, strings(words))), pa.int64())
        return pa.RecordBatch.from_arrays([hashes, words, n], names=["hash", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, ends = [], 0, 0

        def counted() -> pa.RecordBatch:
            found = pa.chunked_array(held).value_counts()
            return rows(found.field("values"), found.field("counts"))

        for batch in chain.from_iterable(map(sliced, batches)):
            words = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").cast(pa.string()))).flatten()
            held.append(words.filter(pc.not_equal(words, "")))
            waiting, ends = waiting + len(held[-1]), ends + batch.num_rows
            if waiting > flush:
                yield counted()
                held, waiting = [], 0
        if held:
            yield counted()
        yield rows(pa.array([END]), pa.array([ends], pa.int64()))

    return (
        docs.select("text").mapInArrow(run, "hash bigint, word string, n bigint").where("n > 0")
        .groupBy("hash", "word").agg(F.sum("n").alias("n"))
    )


@dataclass
class Vocabulary:
    """Subword ids by count: class, share within the class, and row of the input embedding."""

    group: np.ndarray
    share: np.ndarray
    row: np.ndarray
    groups: int
    rows: int

    @property
    def end(self) -> int:
        return len(self.group) - 1


def vocabulary(counts: np.ndarray, begins: np.ndarray, groups: int = 64, rows: int = 4096) -> Vocabulary:
    """Classes of about equal mass, apart for ids that begin a word and that go on in one.

    ``counts`` has one more id than the tokenizer: the end, a class of its own. Counts are
    raised by one, so every id has a chance. Frequent ids have an embedding row each,
    the others share rows by rank.
    """
    mass = counts.astype(np.float64) + 1
    group = np.zeros(len(counts), np.int64)
    kinds = [np.flatnonzero(begins[:-1]), np.flatnonzero(~begins[:-1])]
    total = sum(mass[k].sum() for k in kinds)
    at = 0
    for k, ids in enumerate(kinds):
        mine = max(1, min(groups - 2, round((groups - 1) * mass[ids].sum() / total))) if k == 0 else groups - 1 - at
        order = ids[np.argsort(-mass[ids], kind="stable")]
        middle = np.cumsum(mass[order]) - mass[order] / 2
        place = np.minimum((middle / max(mass[order].sum(), 1) * mine).astype(np.int64), mine - 1)
        group[order] = at + place
        at += mine
    group[-1] = groups - 1
    share = mass / np.bincount(group, mass, groups)[group]
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(len(counts))
    many = rows // 2
    row = np.where(rank < many, rank, many + (rank - many) * (rows - many) // max(len(counts) - many, 1))
    return Vocabulary(group.astype(np.int16), share, row.astype(np.int32), groups, rows)


class Attention:
    """One causal head over the last ``context`` ids, with a residual path and distance weights."""

    def __init__(self, rows: int, groups: int, width: int = 16, context: int = 24, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        self.width, self.context = width, context

        def start(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {
            "embed": start(rows + 1, width) * np.float32(np.sqrt(rows / width)), "q": start(width, width),
            "k": start(width, width), "v": start(width, width), "near": np.zeros(context, np.float32),
            "out": start(width, groups), "direct": start(width, groups), "bias": np.zeros(groups, np.float32),
        }

    @property
    def start_row(self) -> int:
        return len(self.weights["embed"]) - 1

    def mask(self, queries: int, keys: int) -> np.ndarray:
        """Distance weights; minus infinity for keys ahead and for those further than the context."""
        away = (np.arange(keys - queries, keys)[:, None] - np.arange(keys)[None, :])
        held = (away >= 0) & (away < self.context)
        return np.where(held, self.weights["near"][np.clip(away, 0, self.context - 1)], np.float32(-1e9))

    def forward(self, rows: np.ndarray, valid: np.ndarray, queries: int) -> tuple:
        """Log probabilities [windows, queries, groups] of what follows the last ``queries`` rows."""
        w = self.weights
        x = w["embed"][rows]
        last = x[:, -queries:]
        q, k, v = last @ w["q"], x @ w["k"], x @ w["v"]
        logits = q @ k.transpose(0, 2, 1) * np.float32(self.width**-0.5)
        logits += self.mask(queries, rows.shape[1])
        logits += np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
        logits -= logits.max(axis=2, keepdims=True)
        attention = np.exp(logits, out=logits)
        attention /= attention.sum(axis=2, keepdims=True)
        mixed = attention @ v
        out = mixed @ w["out"] + last @ w["direct"] + w["bias"]
        out -= out.max(axis=2, keepdims=True)
        norm = np.log(np.exp(out).sum(axis=2))
        return out, norm, (x, last, q, k, v, attention, mixed)

    def gradients(self, rows: np.ndarray, valid: np.ndarray, target: np.ndarray, weigh: np.ndarray) -> tuple:
        """Mean loss and gradients of all weights for a batch of windows.

        Derivatives of ``forward``, block by block in held arrays. A column is a place in a window and a row a feature, so
        that factors of a place run along whole rows; sums of softmaxes come with the products they divide.
        """
        w, width, n = self.weights, self.width, rows.shape[1]
        kind, size, groups = w["embed"].dtype, len(w["embed"]), len(w["bias"])
        scale = kind.type(width**-0.5)
        into = np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1).T
        onto = np.concatenate([w["direct"], w["out"], w["bias"][None]]).T
        mask, ones, length = self.mask(n, n), np.ones(groups, kind), np.linalg.norm(onto, axis=1).max()
        near_by, every = np.exp(mask), bool(valid.all())
        loss, total = 0.0, max(float(weigh.sum()), 1.0)
        # Bounds over all embeddings; only where they are passed is each block looked at by itself.
        top = [np.square(a).sum(axis=1).max() for a in (w["embed"], *np.split(w["embed"] @ into.T, 3, axis=1))]
        flat = np.sqrt(top[1] * top[2]) + np.abs(w["near"]).max() <= 60
        gentle = length * np.sqrt(top[0] + top[3] + 1) <= 60
        to_into, to_onto, to_near = np.zeros(into.shape), np.zeros(onto.shape), np.zeros((n, n))
        to_x = np.empty((width, rows.size), kind)
        held = 0
        for b in range(0, len(rows), BLOCK):
            at = rows[b : b + BLOCK].reshape(-1)
            many, place = len(at) // n, np.arange(len(at))
            if len(at) != held:
                held = len(at)
                seen, qkv = np.ones((2 * width + 1, held), kind), np.ones((3 * width + 1, held), kind)
                mixed, to_mixed = np.empty((width + 1, held), kind), np.empty((width + 1, held), kind)
                out, to_seen, to = np.empty((groups, held), kind), np.empty((2 * width, held), kind), np.empty((3 * width, held), kind)
                attention, inner = np.empty((many, n, n), kind), np.empty((many, n, n), kind)
            cut = lambda a: a.reshape(len(a), -1, n).transpose(1, 0, 2)
            x, added = seen[:width], seen[width:-1]
            x[:] = w["embed"].take(at, axis=0).T
            np.matmul(into, x, out=qkv[:-1])
            q, k, v = cut(qkv[:width]), cut(qkv[width : 2 * width]), cut(qkv[2 * width :])
            np.matmul(q.transpose(0, 2, 1), k, out=attention)
            most = 0 if flat else np.sqrt(
                np.square(qkv[:width]).sum(axis=0).max() * np.square(qkv[width : 2 * width]).sum(axis=0).max()
            )
            if not flat and most + np.abs(w["near"]).max() > 60:
                attention += mask
                attention += np.where(valid[b : b + BLOCK], kind.type(0), kind.type(-1e9))[:, None, :]
                attention -= attention.max(axis=2, keepdims=True)
                np.exp(attention, out=attention)
            else:
                np.exp(attention, out=attention)
                attention *= near_by
                if not every:
                    attention *= valid[b : b + BLOCK, None, :]
            np.matmul(v, attention.transpose(0, 2, 1), out=cut(mixed))
            inverse = 1 / mixed[-1]
            np.multiply(mixed[:-1], inverse, out=added)
            np.matmul(onto, seen, out=out)
            if not gentle and length * np.sqrt(np.square(seen).sum(axis=0).max()) > 60:
                out -= out.max(axis=0)
            wanted, weight = target[b : b + BLOCK].reshape(-1), weigh[b : b + BLOCK].reshape(-1).astype(kind)
            chosen = out[wanted, place]
            np.exp(out, out=out)
            norm = ones @ out
            loss += float(((np.log(norm) - chosen) * weight).sum())
            out *= weight / norm
            out[wanted, place] -= weight
            to_onto += out @ seen.T
            np.matmul(onto[:, :-1].T, out, out=to_seen)
            np.multiply(to_seen[width:], inverse, out=to_mixed[:-1])
            np.multiply(to_mixed[:-1], added, out=mixed[:-1])
            np.negative(mixed[:-1].sum(axis=0), out=to_mixed[-1])
            np.matmul(cut(to_mixed).transpose(0, 2, 1), v, out=inner)
            inner *= attention
            to_near += inner.sum(axis=0)
            np.matmul(k, inner.transpose(0, 2, 1), out=cut(to[:width]))
            np.matmul(q, inner, out=cut(to[width : 2 * width]))
            np.matmul(cut(to_mixed[:-1]), attention, out=cut(to[2 * width :]))
            to_into += to @ x.T
            np.matmul(into.T, to, out=to_seen[width:])
            np.add(to_seen[width:], to_seen[:width], out=to_x[:, b * n : b * n + held])
        away = np.arange(n)[:, None] - np.arange(n)[None, :]
        near = (away >= 0) & (away < self.context)
        q, k, v = np.split(to_into.T / total, 3, axis=1)
        every_row = rows.reshape(-1).astype(np.intp)
        g = {
            "embed": np.stack([np.bincount(every_row, of, size) for of in to_x], axis=1) / total,
            "q": q * scale, "k": k, "v": v, "near": np.bincount(away[near], to_near[near], self.context) / total,
            "out": to_onto[:, width:-1].T / total, "direct": to_onto[:, :width].T / total, "bias": to_onto[:, -1] / total,
        }
        return loss / total, {name: slope.astype(kind) for name, slope in g.items()}

    def window_gradients(self, ids: np.ndarray, vocab: Vocabulary) -> tuple:
        """Mean loss and gradients for windows of ids, and the number of ids they predict."""
        target = ids[:, 1:]
        given = np.where(ids[:, :-1] >= 0, vocab.row[ids[:, :-1]], self.start_row)
        known = target >= 0
        loss, g = self.gradients(
            given, np.ones(given.shape, bool), np.where(known, vocab.group[target], 0).astype(np.int64),
            known.astype(np.float32),
        )
        return loss, g, int(known.sum())

    def descend(self, g: dict, first: dict, second: dict, step: int, pace: float) -> None:
        """One step of Adam; ``first`` and ``second`` hold its running means."""
        for name, slope in g.items():
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.99 * second[name] + 0.01 * slope * slope
            self.weights[name] -= (
                pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)

    def train(self, windows: np.ndarray, vocab: Vocabulary, steps: int = 600, batch: int = 128,
              rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam on windows of ids (-1 past the end of a text, the first id without a predecessor)."""
        losses: list[float] = []
        if not len(windows):
            return losses
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            ids = windows[random.integers(0, len(windows), batch)]
            loss, g, _ = self.window_gradients(ids, vocab)
            losses.append(loss)
            pace = rate * min(1.0, step / 50) * 0.5 * (1 + np.cos(np.pi * step / steps))
            self.descend(g, first, second, step, pace)
        return losses

    def score(self, ids: list[np.ndarray], vocab: Vocabulary, stride: int = 16, at_once: int = 512) -> np.ndarray:
        """log10 probability of each sequence of ids; windows overlap by context - stride.

        The same function as ``forward``: projections of all embeddings are taken once, and only
        windows that begin before their text need a mask of their own.
        """
        total = np.zeros(len(ids))
        if not ids:
            return total
        w = self.weights
        q, k, v = w["embed"] @ w["q"] * np.float32(self.width**-0.5), w["embed"] @ w["k"], w["embed"] @ w["v"]
        direct = w["embed"] @ w["direct"] + w["bias"]
        ahead, ones = np.exp(self.mask(stride, self.context)), np.ones(direct.shape[1], np.float32)
        full = np.ones(self.context, np.float32)
        unsafe = np.abs(direct).max() + np.abs(v).max() * np.abs(w["out"]).sum(axis=0).max() > 80
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        begin = np.cumsum(sizes) - sizes
        windows = -(-sizes // stride)
        owner = np.repeat(np.arange(len(ids)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        rows, groups, shares = vocab.row[flat], vocab.group[flat].astype(np.int64), np.log(vocab.share[flat])
        reach = np.arange(stride - self.context, stride)
        for b in range(0, len(owner), at_once):
            doc, part = owner[b : b + at_once], number[b : b + at_once]
            target = (part * stride)[:, None] + reach[None, :]
            given = target - 1
            size = sizes[doc][:, None]
            row = np.where(
                (given >= 0) & (given < size), rows[np.clip(begin[doc][:, None] + given, 0, len(rows) - 1)], self.start_row
            )
            asked = row[:, -stride:]
            attention = q.take(asked, axis=0) @ k.take(row, axis=0).transpose(0, 2, 1)
            np.exp(np.minimum(attention, np.float32(60), out=attention), out=attention)
            attention *= ahead
            early = np.flatnonzero(part * stride < self.context - stride + 1)
            attention[early] *= (given[early] >= -1)[:, None, :]
            mixed = attention @ v.take(row, axis=0)
            mixed /= (attention @ full)[:, :, None]
            out = mixed.reshape(-1, self.width) @ w["out"]
            out += direct.take(asked.reshape(-1), axis=0)
            if unsafe:
                np.minimum(out, np.float32(80), out=out)
            target = target[:, -stride:]
            real = target < size
            at = np.where(real, begin[doc][:, None] + target, 0)
            chance = out[np.arange(len(out)), groups[at.reshape(-1)]]
            chance = (chance - np.log(np.exp(out, out=out) @ ones)).reshape(at.shape) + shares[at]
            total += np.bincount(doc, np.where(real, chance, 0).sum(axis=1), len(ids))
        return total / LN10


def subword_counts(words: DataFrame, tokenizer: str) -> DataFrame:
    """(id, n): how often each subword id occurs in the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path(tokenizer))
        for batch in batches:
            codes, sizes = encode.spaced(batch.column("word").to_pylist())
            times = np.repeat(batch.column("n").to_numpy(), sizes)
            ids, place = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int64)), pa.array(np.bincount(place, times, len(ids)).astype(np.int64))],
                names=["id", "n"],
            )

    return (
        words.where(F.col("word") != END).select("word", "n").mapInArrow(run, "id bigint, n bigint")
        .groupBy("id").agg(F.sum("n").alias("n"))
    )


def training_windows(docs: DataFrame, tokenizer: str, end: int, size: int, documents: int, most: int = 8) -> np.ndarray:
    """Windows of ``size`` ids from about ``documents`` texts, at most ``most`` evenly spread in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkIds(tokenizer_path(tokenizer), limit=50_000)
        for batch in batches:
            out = []
            for ids in coder.batch([word_list(t) for t in texts(batch)]):
                whole = np.concatenate([[-2], ids, [end]]).astype(np.int64)
                for at in np.unique(np.linspace(0, max(len(whole) - size, 0), most).astype(np.int64)):
                    part = whole[at : at + size]
                    out.append(np.concatenate([part, np.full(size - len(part), -1)]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["ids"])

    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", documents)
    rows = sample.select("text").mapInArrow(run, "ids array<bigint>").collect()
    return np.array(sorted(r[0] for r in rows), np.int64).reshape(-1, size)


def slot(text: str, slices: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) % slices


def around(ids: np.ndarray, end: int) -> np.ndarray:
    """The ids of a text between its start and its end."""
    whole = np.empty(len(ids) + 2, np.int32)
    whole[0], whole[1:-1], whole[-1] = -2, ids, end
    return whole


def packed(ids: np.ndarray, sizes: np.ndarray, end: int) -> pa.Array:
    """A binary value for each text: its ids, start and end around them, raised by two, in the least bytes that hold ``end``.

    A binary value is one piece to Spark and Parquet, where each number of an array is handled by itself.
    """
    kind = np.min_scalar_type(end + 2)
    edges = np.concatenate([[0], np.cumsum(sizes + 2)])
    laid, inner = np.empty(edges[-1], kind), np.ones(edges[-1], bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    laid[edges[:-1]], laid[edges[1:] - 1], laid[inner] = 0, end + 2, ids + 2
    places = pa.array(edges * kind.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, places.buffers()[1], pa.py_buffer(laid)])


def unpacked(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column of ``packed`` values or of arrays, and where each text begins and the last one ends."""
    if pa.types.is_list(column.type):
        return column.values.to_numpy(), column.offsets.to_numpy()
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    kind = np.min_scalar_type(end + 2)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    places = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize)
    edges = (places // kind.itemsize).astype(np.int64)
    return np.frombuffer(column.buffers()[2], kind, edges[-1]).astype(np.int32) - 2, edges


def coded(docs: DataFrame, tokenizer: str, end: int, slices: int) -> str:
    """Folder of the ids of all texts, start and end around them, dealt to slices by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkIds(tokenizer_path(tokenizer), limit=CHUNKS)
        for batch in chain.from_iterable(map(sliced, batches)):
            said = texts(batch)
            ids = [around(i, end) for i in coder.batch([word_list(t) for t in said])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array([slot(t, slices) for t in said], pa.int32())], names=["ids", "slice"]
            )

    return stage_by(docs.select("text").mapInArrow(run, "ids array<int>, slice int"), "slice")


def cut_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Windows of ``size`` ids, -1 past the end, in which each id but the first is predicted once."""
    steps = -(-(len(ids) - 1) // (size - 1))
    held = np.full(steps * (size - 1) + 1, -1, np.int64)
    held[: len(ids)] = ids
    return held[np.arange(steps)[:, None] * (size - 1) + np.arange(size)[None, :]]


def summed_gradients(part: DataFrame, model: Attention, vocab: Vocabulary, size: int, at_once: int = CALL) -> tuple:
    """Summed loss and gradients over all windows of the texts in ``part``, and the number of predicted ids.

    Tasks add up their own windows, a few tasks add up the tasks; the driver gets sums of weights' size.
    """
    shared = Shared(part.sparkSession, (model, vocab))
    schema = "loss double, n bigint, gradient binary"

    def row(loss: float, n: int, gradient: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([loss], pa.float64()), pa.array([n], pa.int64()), pa.array([gradient.tobytes()], pa.binary())],
            names=["loss", "n", "gradient"],
        )

    def calls(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
        """All windows, ``at_once`` in each call but the last."""
        held, waiting = [], 0
        for batch in batches:
            flat, edges = unpacked(batch.column("ids"), end)
            for k in range(batch.num_rows):
                held.append(cut_windows(flat[edges[k] : edges[k + 1]], size))
                waiting += len(held[-1])
                if waiting < at_once:
                    continue
                windows = np.concatenate(held)
                full = waiting - waiting % at_once
                for b in range(0, full, at_once):
                    yield windows[b : b + at_once]
                held, waiting = [windows[full:].copy()], waiting - full
        if waiting:
            yield np.concatenate(held)

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = shared.value
        total, losses, n = np.zeros(sum(w.size for w in model.weights.values())), 0.0, 0
        for windows in calls(batches, vocab.end):
            loss, g, known = model.window_gradients(windows, vocab)
            total += known * np.concatenate([g[name].reshape(-1) for name in model.weights]).astype(np.float64)
            losses, n = losses + known * loss, n + known
        if n:
            yield row(losses, n, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, losses, n = None, 0.0, 0
        for batch in batches:
            for loss, known, gradient in zip(*(batch.column(c).to_pylist() for c in ("loss", "n", "gradient")), strict=True):
                one = np.frombuffer(gradient, np.float64)
                total = one.copy() if total is None else total + one
                losses, n = losses + loss, n + known
        if n:
            yield row(losses, n, total)

    rows = part.select("ids").mapInArrow(slopes, schema).repartition(4).mapInArrow(add, schema).collect()
    shared.unpersist()
    loss, n = sum(r["loss"] for r in rows), sum(r["n"] for r in rows)
    total = sum((np.frombuffer(r["gradient"], np.float64) for r in rows), np.zeros(sum(w.size for w in model.weights.values())))
    edges = np.cumsum([w.size for w in model.weights.values()])[:-1]
    parts = zip(model.weights.items(), np.split(total, edges), strict=True)
    return loss, {name: of.reshape(w.shape) for (name, w), of in parts}, n


def fit(docs: DataFrame, model: Attention, vocab: Vocabulary, tokenizer: str, size: int,
        slices: int = SLICES, passes: int = 1, rate: float = 0.004) -> list[tuple[float, int]]:
    """Adam over all windows of all texts: a step for each slice of each pass; mean loss and ids of each step.

    The number of steps is fixed, that of the windows in a step grows with the input.
    """
    path = coded(docs, tokenizer, vocab.end, slices)
    held = docs.sparkSession.read.schema("ids array<int>, slice int").parquet(path)
    return fit_coded(held, model, vocab, size, slices, passes, rate)


def fit_coded(held: DataFrame, model: Attention, vocab: Vocabulary, size: int,
              slices: int = SLICES, passes: int = 1, rate: float = 0.004) -> list[tuple[float, int]]:
    """``fit`` on texts that have their ids and slices already."""
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    seen: list[tuple[float, int]] = []
    for number in range(passes * slices):
        loss, g, n = summed_gradients(held.where(F.col("slice") == number % slices), model, vocab, size)
        if n:
            seen.append((loss / n, n))
            pace = rate * (1 - number / (passes * slices))
            model.descend({k: v / n for k, v in g.items()}, first, second, len(seen), pace)
    return seen


def score(
    docs: DataFrame, train: DataFrame | Column, tokenizer: str = TOKENIZER, common_words: int = 65_536,
    sample_documents: int = 2_000, steps: int = 600, passes: int = 1,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``train`` is a table, or a condition on the rows of ``docs``, which then get their ids once for both uses.
    Counts cover all of ``train``, and so do the model's weights: they start from ``steps`` on windows of
    about ``sample_documents`` texts and are fitted in ``passes`` over all windows of all texts. The ``common_words`` most frequent words are broadcast,
    a fixed number; other words of a text meet their counts in a join. Null and empty texts
    are the end alone; repeated rows are scored each; a null id stays null. Without training rows
    all counts are zero and the model is untrained.
    """
    from tokenizers import Tokenizer

    spark, inside = docs.sparkSession, isinstance(train, Column)
    learns = F.coalesce(train, F.lit(False)) if inside else F.lit(False)
    train = docs.where(learns) if inside else train
    counted = stage(word_counts(train))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counted.orderBy(F.desc("n"), "hash").limit(common_words).select("hash", "n").toPandas().sort_values("hash")
    names = Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab()
    counts = np.zeros(max(names.values()) + 2, np.int64)
    for number, times in subword_counts(counted, tokenizer).collect():
        counts[number] = times
    ends = counted.where(F.col("word") == END).select("n").first()
    counts[-1] = ends[0] if ends else 0
    begins = np.zeros(len(counts), bool)
    begins[[k for name, k in names.items() if name.startswith("Ġ")]] = True
    vocab = vocabulary(counts, begins)
    model = Attention(vocab.rows, vocab.groups)
    model.train(training_windows(train, tokenizer, vocab.end, 33, sample_documents), vocab, steps)
    held = prepared(
        docs.select(F.col("doc_id").cast("bigint"), "text", learns.alias("learns")), tokenizer, vocab.end,
        common["hash"].to_numpy(np.int64), common["n"].to_numpy(np.int64),
    )
    if n and inside:
        fit_coded(held.where(F.col("slice") >= 0), model, vocab, 33, passes=passes)
    elif n:
        fit(train, model, vocab, tokenizer, 33, passes=passes)
    shared = Shared(spark, (model, vocab))
    rest = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = shared.value
        for batch in batches:
            flat, edges = unpacked(batch.column("ids"), vocab.end)
            begin, scores = 0, []
            while begin < batch.num_rows:
                # About 2^18 ids at a time; a longer text alone.
                last = max(begin + 1, int(np.searchsorted(edges, edges[begin] + (1 << 18), "right")) - 1)
                scores.append(model.score([flat[edges[k] + 1 : edges[k + 1]].astype(np.int64) for k in range(begin, last)], vocab))
                begin = last
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*kept, "score"]
            )

    kept = ["row", "doc_id", "n_tokens", "known", "base"]
    scored = stage(held.select(*kept, "ids").mapInArrow(
        run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double"
    ))
    seldom = held.select("row", F.explode(F.arrays_zip("rare", "times")).alias("word")).select(
        "row", F.col("word.rare").alias("hash"), F.col("word.times").alias("times")
    )
    more = (
        seldom.join(counted.select("hash", "n"), "hash").groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"))
    )
    return scored.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        "score",
    )


def prepared(docs: DataFrame, tokenizer: str, end: int, hashes: np.ndarray, times: np.ndarray) -> DataFrame:
    """A staged row for each of ``docs``: ids, slice, and the base as far as common words give it.

    ``docs`` has doc_id, text and ``learns``; rows that do not learn are in slice -1. ``hashes``, in order, and ``times``
    are the common words and their counts; ``rare`` and ``times`` of a row are its other words. ``row`` tells repeated rows apart.
    """
    shared = Shared(docs.sparkSession, (hashes, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, times = shared.value
        coder = ChunkIds(tokenizer_path(tokenizer), limit=CHUNKS)
        # By number of a word: its hash, and what it adds to the base; NaN for words that are not common.
        codes, gains = np.empty(1 << 16, np.int64), np.empty(1 << 16)

        def gain(of: np.ndarray) -> np.ndarray:
            if not len(hashes):
                return np.full(len(of), np.nan)
            place = np.minimum(np.searchsorted(hashes, of), len(hashes) - 1)
            return np.where(hashes[place] == of, np.log10(times[place] + 1), np.nan)

        closing = np.array([word_hash(END)], np.int64)
        closing_gain = gain(closing)
        for batch in chain.from_iterable(sliced(b, most=2 << 20) for b in batches):
            rows, said = batch.num_rows, batch.column("text").cast(pa.string()).fill_null("")
            slots = [
                slot(t, SLICES) if learns else -1
                for t, learns in zip(strings(said), batch.column("learns").to_pylist(), strict=True)
            ]
            # Equal words of a slice are looked up once; ``owner`` is the row of each word.
            lists = pc.ascii_split_whitespace(pc.ascii_lower(said))
            words = lists.flatten()
            real = pc.not_equal(words, "")
            owner = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]
            words = words.filter(real).dictionary_encode()
            number, new = coder.numbers(strings(words.dictionary), len(words.dictionary))
            every = number[words.indices.to_numpy()]
            while len(codes) < coder.learned:
                codes, gains = np.resize(codes, 2 * len(codes)), np.resize(gains, 2 * len(gains))
            fresh = slice(coder.learned - len(new), coder.learned)
            codes[fresh] = np.fromiter(map(word_hash, new), np.int64, len(new))
            gains[fresh] = gain(codes[fresh])
            ids = packed(coder.of(every), np.bincount(owner, coder.size[every], rows).astype(np.int64), end)
            sizes = np.bincount(owner, minlength=rows) + 1
            # Words that are not common, the end among them where it is not: runs of equal (row, hash).
            got = gains[every]
            unknown = np.isnan(got)
            of, each = owner[unknown], codes[every[unknown]]
            if np.isnan(closing_gain[0]):
                of, each = np.append(of, np.arange(rows)), np.append(each, np.repeat(closing, rows))
            order = np.lexsort((each, of))
            of, each = of[order], each[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (each[1:] != each[:-1])])[: len(of)])
            often = np.diff(np.append(first, len(of)))
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=rows))]), pa.int32())
            bases = np.bincount(owner, np.where(unknown, 0, got), rows) + np.nan_to_num(closing_gain[0])
            coder.forget(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sizes - np.bincount(of, minlength=rows), pa.int64()),
                 pa.array(bases), pa.ListArray.from_arrays(edges, pa.array(each[first])),
                 pa.ListArray.from_arrays(edges, pa.array(often.astype(np.int32))), ids, pa.array(slots, pa.int32())],
                names=["doc_id", "n_tokens", "known", "base", "rare", "times", "ids", "slice"],
            )

    schema = "doc_id bigint, n_tokens bigint, known bigint, base double, rare array<bigint>, times array<int>, ids binary"
    rows = docs.mapInArrow(run, f"{schema}, slice int").withColumn("row", F.monotonically_increasing_id())
    return docs.sparkSession.read.schema(f"{schema}, row bigint, slice int").parquet(stage_by(rows, "slice"))


def held_out(col: str = "doc_id") -> F.Column:
    return fold(col, 7)
