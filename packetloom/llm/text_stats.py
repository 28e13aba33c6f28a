"""Statistics of whole texts, on which quality rules and scores are learned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm.common import SPACES, texts

SYMBOLS = "#*$%&|<>"
UPPER, LETTERS, DIGITS = (
    bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(48, 58)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each is near one scale whatever the length of the text.
RATES = (
    "log_words", "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate",
    "bang_rate", "digit_rate", "distinct_rate", "top_word_rate", "same_next_rate", "words_per_line",
    "stop_rate", "other_rate",
)


def _repeats(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, times = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """The values of COUNTS and of RATES of one text; all zero for an empty one."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(RATES)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, SPACES))
    repeat = _repeats(ids, len(known))
    size = len(raw)
    letters = size - len(raw.translate(None, LETTERS))
    counts = [n, chars, symbols, dup, repeat]
    rates = [
        np.log1p(n), min(chars / n, 50.0), symbols / n, dup / lines, repeat / n,
        (size - len(raw.translate(None, UPPER))) / max(letters, 1), raw.count(b"!") / n,
        (size - len(raw.translate(None, DIGITS))) / chars, len(known) / n,
        np.bincount(ids).max() / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        min(n / lines, 500.0), (raw.count(b".") + raw.count(b",")) / n, 1 - letters / size,
    ]
    return counts, [float(r) for r in rates]


def with_stats(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` with COUNTS and RATES of the whole text (null counts as empty)."""
    schema = pa.schema(
        [pa.field(c, t) for c, t in zip(keep, _arrow_types(df, keep), strict=True)]
        + [pa.field(c, pa.int64()) for c in COUNTS] + [pa.field(c, pa.float64()) for c in RATES]
    )
    names = ", ".join(
        [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
        + [f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in texts(batch, text)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            rates = np.array([r for _, r in found]).reshape(-1, len(RATES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).cast(schema.field(c).type) for c in keep]
                + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                + [pa.array(rates[:, k]) for k in range(len(RATES))],
                schema=schema,
            )

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, names)


def _arrow_types(df: DataFrame, keep: tuple[str, ...]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for c in keep]
