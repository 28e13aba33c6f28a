"""Running and sliding totals whose tasks stay small however skewed the keys are.

A plain window over a key puts all rows of that key into one task, and a sliding
frame recomputes its buffer for each row. Here a key is cut into chunks of its
ordering axis (time, row number, score) and each chunk into sub-chunks. Aggregates with map-side
combine give the totals of both; exclusive running totals, over the chunks of a key and over the
sub-chunks of a chunk, give what a sub-chunk inherits, added to it as one extra "carry" row. The
sub-chunk is then the window partition, its frame starts at the first row, and no join is needed.

Keys that fit a task need none of this: with ``chunk=None`` the key itself is the window partition, which
takes a single exchange. ``by_density`` counts the rows of each key first and cuts only the keys that are too large.

Sliding measures become running totals too: a row that enters a window of width
``w`` at ``t`` leaves it at ``t + w + 1``, so +v and -v "edges" sum to the value of
the sliding window at any instant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import staged

MINUTE_US = 60_000_000

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Whole:
    """Keys are not cut and dealt to so many tasks, so that a task's share does not grow with the table."""

    tasks: int


#: How a key is cut: not at all, into chunks of a width, or into chunks of a width and each into so many sub-chunks.
Cut = int | tuple[int, int] | Whole | None
#: A hot key is cut by the minute, and each minute into 64 parts.
HOT_CUT = (MINUTE_US, 64)
#: Rows of a key that one task takes; keys with more are cut.
HOT_ROWS = 1 << 20
#: Rows of whole keys that a task gets where there are more of them than the cores take at once.
TASK_ROWS = 250_000


def _place(df: DataFrame, chunk: Cut) -> DataFrame:
    """Add the chunk and the sub-chunk of each row; neither for whole keys."""
    if chunk is None or isinstance(chunk, Whole):
        return df
    width, parts = chunk if isinstance(chunk, tuple) else (chunk, 1)
    at, inside = F.col("_at"), F.pmod(F.col("_at"), F.lit(width))
    part = at - inside if parts == 1 else at - F.pmod(inside, F.lit(max(1, width // parts)))
    return df.withColumns({"_chunk": at - inside, "_part": part})


def _carry(body: DataFrame, keys: list[str], folds: dict[str, str], chunk: Cut) -> DataFrame:
    """One row per (key, sub-chunk), placed just before it, holding all that came earlier."""

    def summed(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*keys, *by).agg(*[_FOLDS[kind](name).alias(name) for name, kind in folds.items()])

    def inherited(order: str, *by: str) -> list[Column]:
        earlier = Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        picked = []
        for name, kind in folds.items():
            value = _FOLDS[kind](name).over(earlier)
            picked.append((F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(name))
        return picked

    if not isinstance(chunk, tuple):
        return summed(body, "_chunk").select(
            *keys, "_chunk", F.col("_chunk").alias("_part"), (F.col("_chunk") - 1).alias("_at"), *inherited("_chunk")
        )
    parts = summed(body, "_chunk", "_part")
    before = summed(parts, "_chunk").select(*keys, "_chunk", (F.col("_chunk") - 1).alias("_part"), *inherited("_chunk"))
    whole = parts.unionByName(before)
    carried = whole.select(*keys, "_chunk", "_part", (F.col("_part") - 1).alias("_at"), *inherited("_part", "_chunk"))
    return carried.where(F.col("_part") >= F.col("_chunk"))


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> tuple[DataFrame | None, Whole | None]:
    """The keys with more than so many rows (None if there are none), and how whole keys are dealt to tasks."""
    counted = staged(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    total, most = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).head()
    tasks = -(-total // TASK_ROWS)
    dealt = Whole(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else None
    return (counted.where(F.col("_n") > rows).select(*keys) if most > rows else None), dealt


def dealt(df: DataFrame, chunk: Cut, *by: str) -> DataFrame:
    """The rows by their keys in the tasks that ``chunk`` names; as they are where it names none."""
    return df.repartition(chunk.tasks, *by) if isinstance(chunk, Whole) else df


def by_density(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator on events of ``src_ip`` run over whole sources, but cut the sources with many rows.

    The operator has a parameter ``chunk``. Given, it holds for all sources; by default sources of more than ``hot_rows``
    rows are cut (``HOT_CUT``) and others not at all.
    """
    @wraps(operator)
    def run(events: DataFrame, *args, chunk: Cut = None, hot_rows: int = HOT_ROWS, **params) -> DataFrame:
        if chunk is not None:
            return operator(events, *args, chunk=chunk, **params)
        hot, whole = hot_keys(events, ["src_ip"], hot_rows)
        if hot is None:
            return operator(events, *args, chunk=whole, **params)
        same = events["src_ip"].eqNullSafe(hot["src_ip"])
        cold = operator(events.join(hot, same, "left_anti"), *args, chunk=whole, **params)
        return cold.unionByName(operator(events.join(hot, same, "left_semi"), *args, chunk=HOT_CUT, **params))

    return run


def attach(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    *,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    edges: Sequence[DataFrame] = (),
    tiebreak: str | None = None,
    chunk: Cut = MINUTE_US,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add running totals up to and including each row.

    Without ``tiebreak`` rows with equal ``at`` see each other (range frame); with it
    they are ordered (row frame). ``edges`` hold further contributions: the key columns,
    ``at`` as ``_at`` and any of the result names; absent ones add nothing. ``base`` is a
    cheaper table with the same keys, ``at`` and values, row for row: chunk totals are then
    taken from it, and costly ``events`` are computed once instead of twice.
    """
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    folds = {**dict.fromkeys(sums, "sum"), **dict.fromkeys(mins, "min"), **dict.fromkeys(maxs, "max")}
    values = {**sums, **mins, **maxs}
    names = [f"_key{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, names)]
    row_type = events.schema
    order = F.col(tiebreak) if tiebreak else F.lit(0)
    own = [
        *key_cols,
        F.col(at).cast("long").alias("_at"),
        *[v.alias(f"_v_{n}") for n, v in values.items()],
    ]
    added = [
        extra.select(
            *key_cols,
            F.col("_at").cast("long").alias("_at"),
            *[
                (
                    F.col(n) if n in extra.columns
                    else F.lit(0 if folds[n] == "sum" else None)
                ).alias(f"_v_{n}")
                for n in values
            ],
        )
        for extra in edges
    ]

    rows = _place(
        events.select(
            F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_row"),
            order.cast("long").alias("_tie"), *own,
        ), chunk
    )
    others = [_place(all_of(added), chunk)] if added else []
    cut = chunk is not None and not isinstance(chunk, Whole)
    if cut:
        totalled = _place(all_of([(events if base is None else base).select(*own), *added]), chunk)
        others.append(_carry(totalled, names, {f"_v_{n}": kind for n, kind in folds.items()}, chunk))
    blank = {"_row": F.lit(None).cast(row_type), "_tie": F.lit(0).cast("long")}
    whole = dealt(all_of([rows, *[other.withColumns(blank) for other in others]]), chunk, *names)
    frame = Window.partitionBy(*names, *(["_part"] if cut else []))
    if tiebreak:
        frame = frame.orderBy("_at", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    else:
        frame = frame.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return (
        whole.select(
            "_row", *[_FOLDS[kind](f"_v_{n}").over(frame).alias(n) for n, kind in folds.items()]
        )
        .where(F.col("_row").isNotNull())
        .select("_row.*", *folds)
    )


def crossings(
    edges: DataFrame, keys: Sequence[str], out_keys: Sequence[str], out: str,
    limit: int = 1, chunk: Cut = MINUTE_US,
) -> DataFrame:
    """Edges of "the running total of ``_d`` per ``keys`` is at least ``limit``".

    The result has ``out_keys``, ``_at`` and +1 / -1 in ``out``.
    """
    keys = list(keys)
    whole = _place(edges.select(*keys, "_at", "_d"), chunk)
    cut = chunk is not None and not isinstance(chunk, Whole)
    if cut:
        whole = whole.unionByName(_carry(whole, keys, {"_d": "sum"}, chunk)).drop("_chunk")
    by = keys + (["_part"] if cut else [])
    # One exchange serves both the merge of equal instants and the window.
    whole = dealt(whole, chunk, *by) if isinstance(chunk, Whole) else whole.repartition(*by)
    instants = whole.groupBy(*by, "_at").agg(F.sum("_d").alias("_d"))
    frame = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    step = (F.col("_total") >= limit).cast("int") - (
        F.col("_total") - F.col("_d") >= limit
    ).cast("int")
    # A carry row sits before its sub-chunk and is no instant of its own.
    real = F.lit(True) if not cut else F.col("_at") >= F.col("_part")
    return (
        instants.withColumn("_total", F.sum("_d").over(frame)).where(real)
        .select(*out_keys, "_at", step.alias(out)).where(F.col(out) != 0)
    )


def enter_leave(
    events: DataFrame, keys: Sequence[str], at: str, width: int, value: Column | None = None
) -> DataFrame:
    """+value at ``at`` and -value when the row has left a window of ``width``."""
    value = F.lit(1) if value is None else value
    return events.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(at).cast("long").alias("_at"), value.alias("_d")),
                F.struct((F.col(at) + width + 1).cast("long").alias("_at"), (-value).alias("_d")),
            )
        ).alias("_e"),
    ).select(*keys, "_e._at", "_e._d")


def leaving(
    events: DataFrame, keys: Sequence[str], at: str, width: int, out: str, value: Column
) -> DataFrame:
    """Only the departures; the rows themselves bring their own arrivals to attach()."""
    return events.select(
        *keys, (F.col(at) + width + 1).cast("long").alias("_at"), (-value).alias(out)
    ).where(F.col(out) != 0)


def distinct_edges(
    events: DataFrame, keys: Sequence[str], item: str, at: str, width: int, out: str,
    chunk: Cut = MINUTE_US,
) -> DataFrame:
    """Edges of the number of distinct items seen in the last ``width`` per key."""
    seen = events.where(F.col(item).isNotNull())
    if chunk is None or isinstance(chunk, Whole):
        return _stays(seen, keys, item, at, width, out, chunk)
    return crossings(
        enter_leave(seen, [*keys, item], at, width), [*keys, item], keys, out, 1, chunk
    )


def _stays(
    seen: DataFrame, keys: Sequence[str], item: str, at: str, width: int, out: str, chunk: Whole | None
) -> DataFrame:
    """``distinct_edges`` of whole keys: a row opens a stay or closes one by the gaps to its neighbours, with no edges of its own."""
    by = [*keys, item]
    rows = dealt(seen.select(*by, F.col(at).cast("long").alias("_at")).where("_at IS NOT NULL"), chunk, *by)
    beside = Window.partitionBy(*by).orderBy("_at")
    now, leaves = F.col("_at"), F.col("_at") + width + 1
    placed = rows.withColumns({"_before": F.lag("_at").over(beside), "_after": F.lead("_at").over(beside)})
    opens = F.col("_before").isNull() | (now - F.col("_before") > width + 1)
    closes = F.col("_after").isNull() | (F.col("_after") > leaves)
    ends = F.array(
        F.when(opens, F.struct(now.alias("_at"), F.lit(1).alias(out))),
        F.when(closes, F.struct(leaves.alias("_at"), F.lit(-1).alias(out))),
    )
    return (
        placed.where(opens | closes).select(*keys, F.explode(ends).alias("_e")).where("_e IS NOT NULL")
        .select(*keys, "_e._at", F.col(f"_e.{out}"))
    )


def all_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
