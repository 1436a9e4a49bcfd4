"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor
flattens them into one segment per turn: texts with their control strings
escaped, other parts as ordered placeholders. What a placeholder stands for is
recorded beside it, with the tokens it expands to. The loss mask covers the
text of assistants.

Segments are rows, and a conversation is its segments in order, so that a
conversation of any length is read as a stream of turns, never as one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = "conv_id long, turn long, role string, parts array<" + PART + ">"
SEGMENT = (
    "conv_id long, turn long, role string, formatted string, mask array<struct<start:long,end:long>>, "
    "attachments array<struct<place:int,type:string,ref:string,tokens:long>>, tokens long"
)

#: Fixed strings of the template.
OPEN, CLOSE = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST]", "[/INST]"
OTHER_OPEN, OTHER_CLOSE = "<<SYS>>", "<</SYS>>"
HEAD_END = "<|text|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (OPEN, CLOSE, USER_OPEN, USER_CLOSE, OTHER_OPEN, OTHER_CLOSE, HEAD_END, *PLACEHOLDERS.values())

#: Tokens that a part expands to: image patches of 28 pixels, 25 frames a second, a page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 512

_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SEGMENT = re.compile(
    r"\A(?:<s>)?(?:(?P<user>\[INST\] )|(?P<other><<SYS>>)(?P<role>.*?)<\|text\|>|(?P<assistant> ))"
    r"(?P<body>.*?)(?: \[/INST\]|<</SYS>>|</s>)\Z", re.DOTALL,
)


def escape(text: str) -> str:
    r"""No control string is left: each ``\`` is doubled, and a ``\`` put after the first sign of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Flat(NamedTuple):
    formatted: str
    mask: list[tuple[int, int]]
    attachments: list[tuple[int, str, str | None, int]]
    tokens: int


class FlattenParts:
    """Visits the parts of a turn in order; parts of other types count as text."""

    def __init__(self):
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.tokens = 0
        self.at = 0
        self.texts: list[str] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-(part.get(side) or PATCH) // PATCH)) for side in ("width", "height"))
        self._attach(part, int(across * down))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._attach(part, 1 if seconds is None or seconds != seconds else max(1, int(seconds * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, PAGE_TOKENS * int(max(1, part.get("pages") or 1)))

    def end_text(self) -> None:
        """Neighbouring texts are one, so that no control string hides in their seam."""
        text, self.texts = "".join(self.texts), []
        self.tokens += len(_WORDS.findall(text))
        escaped = escape(text)
        if escaped:
            self.spans.append((self.at, self.at + len(escaped)))
            self._put(escaped)

    def _attach(self, part: dict, tokens: int) -> None:
        self.end_text()
        self.attachments.append((len(self.attachments), part["type"], part.get("ref"), tokens))
        self.tokens += tokens
        self._put(PLACEHOLDERS[part["type"]])

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)


def format_turn(role: str | None, parts, first: bool) -> Flat:
    """One segment. A conversation opens with its first turn; a null role is the empty role."""
    visitor = FlattenParts()
    for part in parts if parts is not None else ():
        visitor.visit(part)
    visitor.end_text()
    if role == "user":
        head, tail = f"{USER_OPEN} ", f" {USER_CLOSE}"
    elif role == "assistant":
        head, tail = " ", CLOSE
    else:
        head, tail = f"{OTHER_OPEN}{escape(role or '')}{HEAD_END}", OTHER_CLOSE
    head = (OPEN if first else "") + head
    mask = [(a + len(head), b + len(head)) for a, b in visitor.spans] if role == "assistant" else []
    return Flat(head + "".join(visitor.pieces) + tail, mask, visitor.attachments, visitor.tokens)


def read_turn(segment: str) -> tuple[str, list[tuple[str, str]]]:
    """Role and parts (type, text) of a segment, from the segment alone."""
    m = _SEGMENT.match(segment)
    if m is None:
        raise ValueError("not a segment of this template")
    role = "user" if m["user"] else "assistant" if m["assistant"] else unescape(m["role"])
    kinds = {v: k for k, v in PLACEHOLDERS.items()}
    pieces = re.split("(" + "|".join(re.escape(p) for p in kinds) + ")", m["body"])
    return role, [(kinds[p], "") if p in kinds else ("text", unescape(p)) for p in pieces if p]


def _in_order(turns: DataFrame) -> DataFrame:
    """Conversations whole in a partition, their turns in order; equal turns by role and parts."""
    rest = [c for c in turns.columns if c not in ("conv_id", "turn")]
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", *rest)


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = ()
    for batch in batches:
        out = []
        for conv, turn, role, parts in zip(batch["conv_id"], batch["turn"], batch["role"], batch["parts"]):
            conv, turn = (None if pd.isna(x) else int(x) for x in (conv, turn))
            flat = format_turn(role, parts, last != (conv,))
            last = (conv,)
            out.append((conv, turn, role, flat.formatted, [{"start": a, "end": b} for a, b in flat.mask], [
                dict(zip(("place", "type", "ref", "tokens"), x)) for x in flat.attachments
            ], flat.tokens))
        names = ["conv_id", "turn", "role", "formatted", "mask", "attachments", "tokens"]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"conv_id": "Int64", "turn": "Int64"})


def format_conversations(turns: DataFrame) -> DataFrame:
    """One segment per turn (columns of SEGMENT) of a table with conv_id, turn, role, parts.

    Turns are sorted by number, nulls first; equal numbers by role, then parts.
    Null parts and null texts are empty, a null role is the empty role. Rows
    without a conversation form one. Other columns are left out. An empty table
    gives no segments.
    """
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "parts")
    return _in_order(slim).mapInPandas(_segments, SEGMENT)


def text_part(text: Column) -> Column:
    """The list of parts of a turn that is plain text."""
    fields = [F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text")]
    return F.array(F.struct(*fields, *[F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")])).cast(f"array<{PART}>")


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "tokens long, n_attachments long"
)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    key, state = (), None

    def row():
        return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

    for batch in batches:
        out = []
        for conv, formatted, mask, attachments, tokens in zip(*(batch[c] for c in ("conv_id", "formatted", "mask", "attachments", "tokens"))):
            conv = None if pd.isna(conv) else int(conv)
            if key != (conv,):
                if key:
                    out.append(row())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, parts = read_turn(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{''.join(x for _, x in parts)}\n".encode("utf-8", "surrogatepass"))
            for span in mask:
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            for i, x in enumerate((len(formatted), tokens, len(attachments)), 4):
                state[i] += int(x)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if key:
        yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})


def conversation_digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments as a stream: nothing of a conversation is gathered."""
    return segments.mapInPandas(_digests, DIGEST)
