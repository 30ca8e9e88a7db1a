"""Chat formatting with typed content parts.

A visitor flattens each turn's parts: text is escaped, an image, audio or document part becomes a numbered placeholder,
its reference and expanded token count go to the attachments. A turn is "### role: content</turn>" and a line end. "\\",
"#" and "<" inside texts and roles are escaped, so neither a mark nor a placeholder can be forged and every text can be
read back.

The output is a row for each turn, in order, with its place in the conversation's whole text and the span under the
loss mask, so a conversation of any length is formatted and read back as a stream.

Defined cases: null text is empty; null role is the empty role; rows of a conversation are ordered by turn (null first),
then role and text, and repeated rows are turns of their own; a null part is no part, a part of null kind is text, one of an
unknown kind an attachment of no tokens whose placeholder says "other"; rows of a null conv_id are one conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, written

ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<number: int, kind: string, ref: string, start: long, tokens: long>"
SEGMENT = f"conv_id long, seq long, start long, formatted string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>"
_ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(_ATTACHMENT))])


def escape(text: str, table=ESCAPES) -> str:
    for plain, coded in table:
        text = text.replace(plain, coded)
    return text


def unescape(text: str, table=ESCAPES) -> str:
    for plain, coded in reversed(table):
        text = text.replace(coded, plain)
    return text


class Flatten:
    """The visitor of one conversation: a method for each kind of part."""

    def __init__(self):
        self.number, self.found = 0, []

    def visit(self, part: dict, at: int) -> str:
        return KINDS.get(part.get("kind") or "text", Flatten._other)(self, part, at)

    def _text(self, part: dict, at: int) -> str:
        return escape(part.get("text") or "")

    def _attach(self, part: dict, at: int, tokens: int, mark: str | None = None) -> str:
        self.number += 1
        self.found.append({"number": self.number, "kind": part["kind"], "ref": part.get("ref"), "start": at, "tokens": tokens})
        return f"<|{mark or part['kind']} {self.number}|>"

    def _other(self, part: dict, at: int) -> str:
        return self._attach(part, at, 0, "other")

    def _image(self, part: dict, at: int) -> str:
        return self._attach(part, at, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def _audio(self, part: dict, at: int) -> str:
        return self._attach(part, at, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def _document(self, part: dict, at: int) -> str:
        return self._attach(part, at, (part.get("pages") or 0) * PAGE_TOKENS)

    def taken(self) -> list[dict]:
        out, self.found = self.found, []
        return out


KINDS = {"text": Flatten._text, "image": Flatten._image, "audio": Flatten._audio, "document": Flatten._document}


def text_parts(conversations: DataFrame) -> DataFrame:
    """Turns with a text column as turns with one text part."""
    part = F.from_json(F.lit("{}"), PART)
    return conversations.select("conv_id", "turn", "role", F.array(part.withField("kind", F.lit("text")).withField("text", F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("parts"))


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each turn of (conv_id, turn, role, parts array<PART>), see SEGMENT; offsets count code points of the conversation's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, at, visitor = object(), 0, 0, Flatten()
        for batch in blocks(batches, "sized"):
            rows = []
            for row in batch.select(["conv_id", "role", "parts"]).to_pylist():
                if row["conv_id"] != conv:
                    conv, seq, at, visitor = row["conv_id"], 0, 0, Flatten()
                head = OPEN + escape(row["role"], ROLE_ESCAPES) + BETWEEN
                body, place = [], at + len(head)
                for part in (p for p in row["parts"] or () if p is not None):
                    body.append(visitor.visit(part, place))
                    place += len(body[-1])
                text = head + "".join(body) + CLOSE
                lost = row["role"] == loss_role
                rows.append((conv, seq, at, text, at + len(head) if lost else None, place if lost else None, visitor.taken()))
                seq, at = seq + 1, at + len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT.types, strict=True)], schema=_SEGMENT)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    sized = F.concat_ws("", F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))))
    return _sorted(rows.withColumn("sized", sized), "turn", "role", "sized").mapInArrow(run, SEGMENT)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, attachment_tokens."""
    names = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "attachments": pa.int64(), "attachment_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def result(rows):
            if state is not None:
                turns, digest, lost, loss_digest, chars, attached, tokens = state
                rows.append((conv, turns, digest.hexdigest(), lost, loss_digest.hexdigest(), chars, attached, tokens))

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], names=[*names])

        for batch in blocks(batches, "formatted"):
            rows = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    result(rows)
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                text = row["formatted"]
                head, between, body = text.partition(BETWEEN)
                if not (head.startswith(OPEN) and between and body.endswith(CLOSE)):
                    raise ValueError(f"conversation {conv}: a turn without its marks")
                role, body = unescape(head.removeprefix(OPEN), ROLE_ESCAPES), unescape(body.removesuffix(CLOSE))
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                if row["loss_start"] is not None:
                    lost = unescape(text[row["loss_start"] - row["start"] : row["loss_end"] - row["start"]])
                    state[2] += len(lost)
                    state[3].update(lost.encode("utf-8", "replace"))
                state[4] = row["start"] + len(text)
                state[5] += len(row["attachments"])
                state[6] += sum(a["tokens"] for a in row["attachments"])
            if rows:
                yield made(rows)
        rows = []
        result(rows)
        if rows:
            yield made(rows)

    return _sorted(segments, "seq").mapInArrow(run, ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in names.items()))


def formatted(conversations: DataFrame) -> DataFrame:
    """Format a (conv_id, turn, role, text) table into a written table of turns."""
    return written(format_turns(text_parts(conversations)), "chat")


PLANTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
