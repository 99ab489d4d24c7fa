"""Chat formatting with typed content parts.

A turn's content is a plain text or a JSON list of parts ({"type": "text" | "image" | "audio" | "document", ...}). ``Flattener`` visits the
parts of a conversation in order: text stays, every other part becomes a numbered placeholder (``<|image_1|>``) in its place, with a record of the
attachment (kind, reference, turn, part, expanded tokens). Expanded tokens are what the placeholder stands for in a model's input:
an image counts ``IMAGE_BASE`` + ``IMAGE_TILE`` for each tile of 512 x 512 (one tile if its size isn't known), audio ``AUDIO_RATE`` a second
begun, a document its text's tokens if it carries its text, else ``PAGE`` a page (one at least). A size that isn't a number above 0 and up to
``MOST`` is none. Text counts its tokens in
a public byte-level vocabulary; role marks count one each.

Cases: rows without a conversation id belong to none and are left out; a null turn stands first; a null role is "unknown"; a null or empty
text is a turn without parts. Rows that repeat another wholly count once; rows of one turn that differ stand in the order of role and text.
Content that looks like JSON but is not a list of typed parts (or is nested too deeply to be read) is plain text; halves of surrogate pairs become U+FFFD; a part of another type, or without its reference, is kept as
an attachment of kind "unknown" or with a null reference. Marks that occur in texts are broken up ("<|" becomes "< |"), so that the marks in the result are
those of this module. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder

IMAGE_BASE, IMAGE_TILE, AUDIO_RATE, PAGE = 85, 170, 25, 600
MOST = 1 << 24
SCHEMA = (
    "conv_id long, n_turns int, n_parts int, text string, "
    "attachments array<struct<kind:string,ref:string,turn:int,part:int,n_tokens:long>>, n_text_tokens long, n_tokens long"
)
_TARGET = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int32()), ("n_parts", pa.int32()), ("text", pa.string()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64())]))),
        ("n_text_tokens", pa.int64()), ("n_tokens", pa.int64()),
    ]
)


def parts_of(content: str | None) -> list[dict[str, Any]]:
    """The typed parts of a turn."""
    if not content:
        return []
    if content.lstrip()[:1] == "[":
        try:
            got = json.loads(content)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, list) and got and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in got):
            return got
    return [{"type": "text", "text": content}]


def _number(part: dict, key: str) -> float | None:
    v = part.get(key)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v <= MOST else None


def _valid(text: str) -> str:
    """The text as Unicode that can be stored: halves of surrogate pairs are replaced."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class Flattener:
    """Visitor over the parts of one conversation."""

    def __init__(self, count):
        self.count = count
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.text_tokens = self.marks = self.n_parts = 0
        self.numbers: dict[str, int] = {}
        self.visits = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def turn(self, at: int, role: str | None, content: str | None) -> None:
        self.out.append(f"<|{self.plain(role or 'unknown')}|>\n")
        for k, part in enumerate(parts_of(content)):
            self.n_parts += 1
            self.visits.get(part["type"], self.visit_other)(part, at, k)
        self.out.append("<|end|>\n")
        self.marks += 2

    @staticmethod
    def plain(text: str) -> str:
        return text.replace("<|", "< |")

    def visit_text(self, part: dict, at: int, k: int) -> None:
        text = part.get("text")
        text = self.plain(_valid(text) if isinstance(text, str) else "")
        self.out.append(text)
        self.text_tokens += self.count(text)

    def visit_image(self, part: dict, at: int, k: int) -> None:
        w, h = _number(part, "width"), _number(part, "height")
        tiles = math.ceil(w / 512) * math.ceil(h / 512) if w and h else 1
        self.attach("image", part, at, k, IMAGE_BASE + IMAGE_TILE * tiles)

    def visit_audio(self, part: dict, at: int, k: int) -> None:
        self.attach("audio", part, at, k, AUDIO_RATE * math.ceil(_number(part, "seconds") or 1))

    def visit_document(self, part: dict, at: int, k: int) -> None:
        text = part.get("text")
        self.attach("document", part, at, k, self.count(_valid(text)) if isinstance(text, str) else PAGE * math.ceil(_number(part, "pages") or 1))

    def visit_other(self, part: dict, at: int, k: int) -> None:
        self.attach("unknown", part, at, k, 0)

    def attach(self, kind: str, part: dict, at: int, k: int, tokens: int) -> None:
        n = self.numbers[kind] = self.numbers.get(kind, 0) + 1
        self.out.append(f"<|{kind}_{n}|>")
        ref = next((part[x] for x in ("url", "path", "id") if isinstance(part.get(x), str)), None)
        self.attachments.append({"kind": kind, "ref": None if ref is None else _valid(ref), "turn": at, "part": k, "n_tokens": tokens})


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation (see SCHEMA)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).where("conv_id IS NOT NULL")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                turns = sorted(turns, key=lambda t: (t["turn"] is not None, t["turn"] or 0, t["role"] or "", t["text"] or ""))
                f = Flattener(lambda t: len(enc.encode_ordinary(t)))
                for at, t in enumerate(turns):
                    f.turn(at, t["role"], t["text"])
                expanded = f.text_tokens + f.marks + sum(a["n_tokens"] for a in f.attachments)
                out.append({"conv_id": conv, "n_turns": len(turns), "n_parts": f.n_parts, "text": "".join(f.out), "attachments": f.attachments, "n_text_tokens": f.text_tokens, "n_tokens": expanded})
            yield pa.RecordBatch.from_pylist(out, schema=_TARGET)

    return grouped.mapInArrow(run, SCHEMA)
