"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Addresses, numbers and cards of fixed formats, and long hexadecimal keys, are the seeds. The words
in front of seeds become lexical patterns. Patterns and the instances they precede form a graph;
Spark scores patterns by their instances and instances by their patterns, in turns. Confident
patterns then reveal identifiers that no format describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import only_ids, other_ids, shielded, stage

#: The formats, and what a text must hold for one to occur. Possessive repeats and
#: look-behinds leave the matches as they are and keep long runs linear.
FORMATS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
    ),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = tuple(FORMATS)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word that holds a digit: what a pattern may reveal.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
SPAN = "struct<begin:int,end:int,value:string>"
LEAD = "struct<begin:int,end:int,value:string,before:string>"
#: Places are summed in blocks of so many matches, so that a text full of them stays cheap.
BLOCK = 128


def _spans(text: Column, pattern: str, lead: int = 0) -> Column:
    """All matches in order, with places in code points and ``lead`` characters in front.

    The text is split at the matches; sums of the lengths of pieces and matches are the places,
    first within blocks of matches, then over the blocks.
    """
    kind = LEAD if lead else SPAN
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
        lambda piece, value: F.struct(F.length(piece).alias("gap"), value.alias("value"), *(
            [F.substring(piece, -lead, lead).alias("before")] if lead else []
        )),
    )

    def place(begin: Column, step: Column) -> Column:
        more = [step["before"].alias("before")] if lead else []
        return F.struct(
            begin.alias("begin"), (begin + F.length(step["value"])).alias("end"), step["value"].alias("value"), *more
        )

    def last(spans: Column) -> Column:
        return F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice(steps, b * BLOCK + 1, BLOCK), F.array().cast(f"array<{kind}>"),
            lambda done, step: F.concat(done, F.array(place(last(done) + step["gap"], step))),
        ),
    )
    starts = F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda done, block: F.concat(done, F.array(F.element_at(done, -1) + last(block))),
    )
    moved = F.zip_with(
        blocks, F.slice(starts, 1, F.size(blocks)),
        lambda block, start: F.transform(block, lambda s: F.struct(
            (s["begin"] + start).alias("begin"), (s["end"] + start).alias("end"), s["value"].alias("value"),
            *([s["before"].alias("before")] if lead else []),
        )),
    )
    return F.when(F.size(found) > 0, F.flatten(moved)).otherwise(F.array().cast(f"array<{kind}>"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
        ),
    )
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one format; empty for an empty or null text."""
    pattern, needed = FORMATS[kind]
    text = F.coalesce(text, F.lit(""))
    found = F.filter(_spans(text, pattern), lambda span: _valid(kind, span["value"]))
    return F.when(text.rlike(needed), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_base(docs: DataFrame, *more: str) -> DataFrame:
    """One array of spans per format beside the columns ``more``."""
    return docs.select(*more, *[base_spans(F.col("text"), kind).alias(kind) for kind in KINDS])


def instances(docs: DataFrame, key: str) -> DataFrame:
    """Words that hold a digit, with place, core, the two words in front, and whether a seed.

    The core drops punctuation at both ends. The words in front are lowered and stripped of
    what is neither letter, digit nor '=' or ':'.
    """
    rows = (
        docs.where(F.col("text").rlike("[0-9]"))
        .select(key, *[base_spans(F.col("text"), k).alias(k) for k in KINDS],
                F.explode(_spans(F.col("text"), INSTANCE, 80)).alias("word"))
    )
    value = F.col("word.value")
    lead = F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}]*+", 0))
    core = F.regexp_replace(value, r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    begin = F.col("word.begin") + lead
    plain = F.regexp_replace(F.lower("word.before"), r"[^\p{L}\p{N}=:\x20\x09-\x0D]++", "")
    parts = F.filter(F.split(F.trim(plain), r"[\x20\x09-\x0D]++"), lambda w: w != "")
    front = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), " "))
    inside = F.lit(False)
    for kind in KINDS:
        inside = inside | F.exists(
            F.col(kind), lambda s: (s["begin"] < F.col("__end")) & (s["end"] > F.col("__begin"))
        )
    hexadecimal = F.lower("core").rlike("^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}$")
    return (
        rows.select(
            key, *KINDS, begin.alias("__begin"), (begin + F.length(core)).alias("__end"),
            core.alias("core"), front.alias("pattern"),
        )
        .withColumn("base", inside)
        .select(
            key, F.col("__begin").alias("begin"), F.col("__end").alias("end"), "core", "pattern", "base",
            (F.col("base") | hexadecimal).alias("seed"),
        )
        .where("end > begin AND pattern IS NOT NULL")
    )


def patterns(found: DataFrame, rounds: int = 3, least_values: int = 3, confidence: float = 0.8) -> DataFrame:
    """(pattern, score): patterns whose instances are identifiers with confidence.

    An instance is a value. Seeds score 1 and stay so; others start at 0. A pattern scores the mean of its
    distinct values, over one more than their number; a value takes its best pattern's score. Only
    patterns with ``least_values`` distinct values take part.
    """
    edges = stage(
        found.groupBy("pattern", "core").agg(F.max(F.col("seed").cast("int")).cast("double").alias("seed"))
    )
    scores = edges.groupBy("core").agg(F.max("seed").alias("score"))
    scored = None
    for turn in range(rounds):
        scored = (
            edges.join(scores, "core").groupBy("pattern")
            .agg(F.sum("score").alias("total"), F.count("*").alias("values"))
            .where(F.col("values") >= least_values)
            .select("pattern", (F.col("total") / (F.col("values") + 1)).alias("score"))
        )
        if turn + 1 < rounds:
            strong = scored.where(F.col("score") >= confidence)
            scores = stage(
                edges.join(strong, "pattern", "left").groupBy("core")
                .agg(F.max(F.greatest("seed", F.coalesce("score", F.lit(0.0)))).alias("score"))
            )
    return stage(scored.where(F.col("score") >= confidence))


def discovered(docs: DataFrame, key: str, **options: object) -> DataFrame:
    """(key, found): the spans that confident patterns reveal and no format covers."""
    seen = stage(instances(docs, key))
    strong = patterns(seen, **options)
    return (
        seen.where("NOT base").join(strong, "pattern", "left_semi")
        .groupBy(key).agg(F.array_sort(F.collect_set(F.struct("begin", "end", F.col("core").alias("value")))).alias("found"))
    )


def merged(spans: Column) -> Column:
    """Sorted (begin, end) pairs with overlaps joined."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        alone = F.struct(span["begin"].alias("begin"), span["end"].alias("end"))
        return F.when(
            last.isNotNull() & (span["begin"] < last["end"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(alone)))

    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    return F.aggregate(plain, F.array().cast("array<struct<begin:int,end:int>>"), add)


def masked(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each of the disjoint, sorted spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        spans, start,
        lambda done, s: F.struct(
            F.concat(done["out"], F.substring(text, done["at"] + 1, s["begin"] - done["at"]), F.lit(mark)).alias("out"),
            s["end"].alias("at"),
        ),
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text) - done["at"])),
    )


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options: object) -> DataFrame:
    """``keep`` and one array of spans per format and of ``found`` ones, for every row.

    A null or empty text has no spans. Repeated rows are searched each; the spans that patterns reveal
    are joined by a hash of the text, so a null or repeated id does no harm. Only rows whose text may have such spans
    are moved for the join; the others stay where they are read.
    """
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    more = stage(discovered(keyed.select(F.col("__text"), "text"), "__text", **options))
    empty = F.array().cast(f"array<{SPAN}>")
    moved = (
        with_base(only_ids(keyed, "__text", more), *keep, "__text").join(more, "__text", "left")
        .withColumn("found", F.coalesce("found", empty)).drop("__text")
    )
    rest = with_base(other_ids(keyed, "__text", more), *keep, "__text").drop("__text").withColumn("found", empty)
    return moved.unionByName(rest)


def without_identifiers(docs: DataFrame, mark: str = "[REDACTED]", **options: object) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; all rows and columns stay."""
    hidden, restore = shielded(docs, "doc_id", "text")
    held = find(hidden, tuple(hidden.columns), **options)
    spans = merged(F.concat(*[F.col(k) for k in (*KINDS, "found")]))
    text = F.when(F.size(spans) > 0, masked(F.col("text"), spans, mark)).otherwise(F.col("text"))
    return restore(held.withColumn("text", text))
