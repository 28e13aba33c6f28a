"""Chat formatting with typed content parts.

A turn is a list of parts: text, images, audio and documents. A visitor flattens them in order;
each attachment leaves a placeholder, its reference is recorded, and the tokens it expands to
are counted. The template marks turns and escapes control strings inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.packing import TOKENIZER, ChunkIds, tokenizer_path

PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"
ATTACHMENTS = "array<struct<place:int,type:string,ref:string,tokens:bigint>>"
#: What a turn of each role stands between. Other roles are named inside.
TURNS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE] ", "[SEP]", " [/ROLE]"
_ESCAPE = re.compile(r"\\|<(?=/?s>|\|)|\[(?=/?(?:INST|SYS|ROLE|SEP)\])")
_READ = re.compile(
    r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>"
    r"|\[ROLE\] (?P<name>.*?)\[SEP\](?P<other>.*?) \[/ROLE\]", re.S,
)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Tokens per image tile of 512 x 512 pixels, second of audio and document page.
RATES = {"image": (256, 512 * 512), "audio": (25, 1), "document": (600, 1)}


def escape(text: str) -> str:
    """A backslash after each backslash and after the first character of each control string."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)|\\\Z", lambda m: m[1] or "", _drop_marks(text), flags=re.S)


def _drop_marks(text: str) -> str:
    """Without placeholders: they stand for attachments and belong to no text."""
    return _PLACE.sub("", text)


@dataclass
class Flattener:
    """Visits parts in order; unknown types are kept as text.

    Texts that follow each other are one text: escaped part by part, a control string cut in two
    would come to life where they meet.
    """

    coder: ChunkIds
    out: list[str] = field(default_factory=list)
    waiting: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part.get("text") or "")

    def close(self) -> str:
        """Ends the text that was begun; all that was flattened."""
        text = "".join(self.waiting)
        self.waiting.clear()
        self.out.append(escape(text))
        self.tokens += len(next(self.coder.texts([text])))
        return "".join(self.out)

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        self.close()
        per, unit = RATES[kind]
        tokens = per * max(1, -(-max(part.get("size") or 0, 0) // unit))
        place = len(self.attachments)
        self.out.append(f"<|{kind}:{place}|>")
        self.attachments.append((place, kind, part.get("ref"), tokens))
        self.tokens += tokens


def turn_text(role: str | None, body: str) -> tuple[str, int, int]:
    """One turn of the template, and where the trained part begins and ends in it (0, 0: none)."""
    role = role or ""
    if role in TURNS:
        before, after = TURNS[role]
    else:
        before, after = f"{OTHER}{escape(role)}{NAMED}", OTHER_END
    loss = (len(before), len(before) + len(body)) if role == "assistant" else (0, 0)
    return before + body + after, *loss


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, trained) of each turn of formatted text, unescaped."""
    for match in _READ.finditer(formatted):
        if match["other"] is not None:
            yield unescape(match["name"]), unescape(match["other"]), False
        else:
            yield match.lastgroup, unescape(match[match.lastgroup]), match.lastgroup == "assistant"


def text_parts(messages: DataFrame) -> DataFrame:
    """Messages with a plain ``text`` as messages of one text part (null: empty)."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"),
    )
    return messages.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def format_turns(messages: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, turn, role, formatted, loss_begin, loss_end, attachments and tokens of every row.

    ``messages`` has conv_id, turn, role and parts. A null role is the role ''; null or empty parts are an empty text;
    repeated rows give a row each; null ids and turns stay null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkIds(tokenizer_path(tokenizer), limit=100_000)
        for batch in batches:
            rows = []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                visitor = Flattener(coder)
                for part in parts or []:
                    visitor.visit(part or {})
                body = visitor.close()
                held = [
                    {"place": p, "type": t, "ref": r, "tokens": n} for p, t, r, n in visitor.attachments
                ]
                rows.append((*turn_text(role, body), held, visitor.tokens))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kind = pa.list_(pa.struct([
                ("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(cols[0], pa.string()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], kind),
                 pa.array(cols[4], pa.int64())],
                names=["conv_id", "turn", "role", "formatted", "loss_begin", "loss_end", "attachments", "tokens"],
            )

    return messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "parts").mapInArrow(
        run, "conv_id bigint, turn bigint, role string, formatted string, loss_begin bigint, loss_end bigint, "
        f"attachments {ATTACHMENTS}, tokens bigint",
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns in order of turn.

    Turns stream through their task in order: hashes and counts are all that is held of a
    conversation, however long it is. Rows without an id are one conversation. Equal turns are
    ordered by role and text. ``loss_*`` cover the text under the mask, unescaped.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "tokens")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        done: list[tuple] = []

        def fresh() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]

        def close() -> tuple:
            return (now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5])

        held = fresh()
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end", "tokens")]
            for conv, formatted, begin, end, tokens in zip(*cols, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close())
                    now, held = (conv,), fresh()
                for role, text, _ in read_turns(formatted):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                trained = unescape(formatted[begin:end])
                held[2] += len(trained)
                held[3].update(trained.encode())
                held[4] += len(formatted)
                held[5] += tokens
            if done:
                yield _rows(done, names, kinds)
                done = []
        if now is not None:
            yield _rows([close()], names, kinds)

    return (
        turns.select("conv_id", "turn", "role", "formatted", "loss_begin", "loss_end", "tokens")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", _said())
        .mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                    "loss_sha256 string, formatted_chars bigint, tokens bigint")
    )


def _said() -> F.Column:
    """The body of a formatted turn as it reads, by which equal turns are ordered."""
    size = F.length("formatted")
    ends = F.when(F.col("role").isin(*TURNS), F.lit(0)).otherwise(len(OTHER_END))
    for role, (_, after) in TURNS.items():
        ends = F.when(F.col("role") == role, len(after)).otherwise(ends)
    return F.regexp_replace(F.substring("formatted", F.lit(1), size - ends), r"(?s)\\(.)", "$1")


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))
