"""Chat formatting of turns whose content is a list of typed parts.

A visitor flattens the parts of a turn: neighbouring texts are joined and escaped as one, every image, audio or document
becomes a numbered placeholder and a row of attachment references with the tokens that it will expand to and its place.
Turns stand between control strings; where such a string occurs inside a text or a role, a backslash after its first
character breaks it, and one more is added to those already there, so that removing one restores the text. Reading back
takes placeholders out by their recorded places, so a text that looks like one stays text.

The output has one row for each turn, in order within its conversation; the concatenation of their ``formatted`` is
the conversation. Work on a conversation streams through a task row by row, so memory does not grow with its length.
Rows of a conversation are ordered by turn, then role, then text; nulls first. A null text is empty, a null role the
empty role, a null kind is text, rows of a null conv_id are one conversation. Repeated rows are repeated turns. Turns are
never cut, however long. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
#: Strings that this template or common others give a meaning.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL) + r"|\|(?:" + "|".join(KINDS) + r")_[0-9]+\|>"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")

PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: Tokens of attachments: of an image for each patch, of audio for each second, of a document for each page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256

FORMATTED = f"conv_id bigint, seq bigint, role string, formatted string, loss array<struct<start: bigint, end: bigint>>, attachments array<struct<ordinal: bigint, kind: string, ref: string, tokens: bigint, at: bigint>>, prompt_parts int"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def placeholder(kind: str, ordinal: int) -> str:
    return f"<|{kind}_{ordinal}|>"


class Flattener:
    """Visits the parts of one conversation's turns in order."""

    def __init__(self) -> None:
        self.attached = 0

    def turn(self, parts: list[dict[str, Any] | None], begin: int) -> tuple[str, list[tuple[int, int]], list[dict[str, Any]]]:
        """The parts as template text that begins at ``begin``, the spans of its texts, and its attachments."""
        out, at, spans, attachments, run = [], begin, [], [], []
        for part in [*parts, None]:
            part = part or {}
            kind = part.get("kind") or "text"
            if kind == "text" and part:
                run.append(self.visit_text(part))
                continue
            # Neighbouring texts are one string: a control string may be spread over them.
            if text := escape("".join(run)):
                spans.append((at, at + len(text)))
                out.append(text)
                at += len(text)
            run = []
            if part:
                mark, attachment = self.visit(kind, part)
                attachments.append(attachment | {"at": at})
                out.append(mark)
                at += len(mark)
        return "".join(out), spans, attachments

    def visit(self, kind: str, part: dict[str, Any]) -> tuple[str, dict[str, Any]]:
        method = getattr(self, f"visit_{kind}", None)
        if kind not in KINDS or method is None:
            raise ValueError(f"unknown part: {kind}")
        self.attached += 1
        return placeholder(kind, self.attached), {"ordinal": self.attached, "kind": kind, "ref": part.get("ref"), "tokens": method(part)}

    def visit_text(self, part: dict[str, Any]) -> str:
        return part.get("text") or ""

    def visit_image(self, part: dict[str, Any]) -> int:
        return math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH)

    def visit_audio(self, part: dict[str, Any]) -> int:
        return math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE)

    def visit_document(self, part: dict[str, Any]) -> int:
        return (part.get("pages") or 0) * PAGE_TOKENS


def _role_out(role: str | None) -> str:
    return escape(json.dumps(role or "", ensure_ascii=False)[1:-1])  # no line breaks inside


def _role_in(role: str) -> str:
    return json.loads(f'"{unescape(role)}"')


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("ordinal", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))), ("prompt_parts", pa.int32())])
    conv, seq, flat = object(), 0, Flattener()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, seq, flat = row["conv_id"], 0, Flattener()
            head = f"{OPEN}{_role_out(row['role'])}\n"
            parts = [p for p in row["parts"] or [] if p]
            text, spans, attachments = flat.turn(parts, len(head))
            loss = [{"start": a, "end": b} for a, b in spans] if row["role"] == "assistant" else []
            out.append({"conv_id": conv, "seq": seq, "role": row["role"] or "", "formatted": f"{head}{text}{CLOSE}\n", "loss": loss, "attachments": attachments, "prompt_parts": len(parts)})
            seq += 1
        yield pa.RecordBatch.from_pylist(out, schema)


def text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts of turns that only have a text."""
    part = F.struct(*[F.lit("text").alias("kind"), F.col("text").alias("text")], F.lit(None).cast("string").alias("ref"), *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows of FORMATTED from (conv_id, turn, role, parts). ``loss``: the spans, in characters of ``formatted``, that training should learn."""
    dealt = turns.select("conv_id", "turn", "role", F.col("parts").cast(PARTS).alias("parts")).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "parts").mapInArrow(_format, FORMATTED)


def parse(formatted: str, attachments: list[dict[str, Any]] | None = None) -> tuple[str, str]:
    """Role and text of a formatted turn, without the placeholders of its attachments."""
    begin = formatted.index("\n") + 1
    end = len(formatted) - len(CLOSE) - 1
    texts = []
    at = begin
    for x in attachments or []:
        texts.append(unescape(formatted[at : x["at"]]))
        at = x["at"] + len(placeholder(x["kind"], x["ordinal"]))
    texts.append(unescape(formatted[at:end]))
    return _role_in(formatted[len(OPEN) : begin - 1]), "".join(texts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    conv, state, begun = None, None, False

    def begins(row: dict[str, Any]) -> bool:
        """Whether the row begins a conversation; fails on a turn that is missing or there twice."""
        new = not begun or row["conv_id"] != conv
        if row["seq"] != (0 if new else state[0]):
            raise ValueError(f"conversation {row['conv_id']} lacks a turn before its {row['seq']}-th, or has it twice")
        return new

    def done() -> tuple:
        n, turns, chars, loss, formatted, count, tokens = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count, tokens

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if begins(row):
                if begun:
                    out.append(done())
                conv, state, begun = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], True
            role, text = parse(row["formatted"], row["attachments"])
            learnt = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss"])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(row["formatted"])
            state[5] += len(row["attachments"])
            state[6] += sum(a["tokens"] for a in row["attachments"])
        yield table(out)
    if begun:
        yield table([done()])


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from the rows that ``format_turns`` returned, in whatever order they now are.

    A turn that is missing within a conversation, or there twice, is an error.
    """
    formatted = formatted.select("conv_id", "seq", "formatted", "loss", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    out = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    return formatted.mapInArrow(_digests, out)
