"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``SPAN`` characters cuts a text into chunks wherever the hash has
``CUT_BITS`` zero bits, so equal passages give equal chunks wherever they stand. Documents are first routed by
their smallest chunk hash (copies and near copies meet; as in extreme binning), and each task encodes a chunk once while its cache of
``CACHE_CHARS`` characters holds it. What a chunk's tokens are does not depend on the cache, so neither does the result.

Chunks are joined by repair. The stretch around a join, from a place before the left chunk's end to one behind the right chunk's
beginning, is encoded again, and it grows to further places until its first tokens are those that the left chunk has there and its last
tokens those of the right chunk. Places are where a character of one class (letter, number, other mark) is followed by another class
or a space: the tokenizer's pre-splitting cuts there whatever else the text holds, in any script, so what agrees there stays the same
beyond, and the result is token for token that of encoding the whole text at once. A chunk that has no two such places, such as part of a
long run of ideographs, is not reused: it is encoded together with its neighbours up to the next places.

The vocabulary is a public byte-level one (ranks file; a parameter, never copied or trained). Decoding joins the tokens' bytes.

Cases: a null text has null tokens; an empty text has none. A null id is encoded all the same. Repeated rows are
encoded alike, one row each. Extra columns are ignored. Texts are encoded whole, however long. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textcore import give_back, joined, mix, powers, prefix_sums, text_slices

VOCABULARY = os.environ.get("QUILLSPARK_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN, CUT_BITS = 24, 9
CACHE_CHARS = 8 << 20
PLACES = 16  # kept at either end of a chunk
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = 1, 2, 3, 4, 0


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point, of those that Unicode 3.2 and today's tables class alike; no version of a regular expression library differs on them."""
    out = np.zeros(0x110000, np.uint8)
    for c in [*range(0xD800), *range(0xE000, 0x2FA20)]:
        s = chr(c)
        old, new = unicodedata.ucd_3_2_0.category(s), unicodedata.category(s)
        if old[0] != new[0] or old == "Cn" or old[0] == "C" and c > 0x7F:
            continue
        if old[0] in "LN":
            out[c] = _LETTER if old[0] == "L" else _NUMBER
        elif s in " \t\n\r":
            out[c] = _SPACE
        elif old[0] in "PSM":
            out[c] = _OTHER
    return out


class Layout:
    """Chunks and places of some texts, as positions in the joined text."""

    def __init__(self, texts: list[str | None], places: bool = True):
        self.raw, self.base = raw, base = joined(texts)
        self.prefix, self.down = prefix_sums(raw), powers(len(raw) + 1)[1]
        ends = np.arange(SPAN, len(raw))
        h = self.span(ends - SPAN, ends)
        cut = ends[(h & np.uint64((1 << CUT_BITS) - 1)) == 0]
        text = np.searchsorted(base, cut, "right") - 1
        cut = cut[cut - base[text] >= SPAN]  # all that the hash read is of this text
        self.edges = np.unique(np.concatenate([cut, base]))
        if places:
            cls = classes()[raw]
            a, b = cls[:-1], cls[1:]
            sure = (a != b) & (a != _UNSURE) & (b != _UNSURE) & (a != _SPACE)
            sure &= ~((raw[:-1] == 0x27) & (b == _LETTER))  # 's and its like are cut as one
            self.places = np.flatnonzero(sure) + 1

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.down[a] + np.uint64(1))

    def routes(self) -> np.ndarray:
        """Smallest chunk hash of each text."""
        last = np.isin(self.edges[1:], self.base)
        h = self.span(self.edges[:-1], self.edges[1:] - last)
        return np.minimum.reduceat(h, np.searchsorted(self.edges, self.base[:-1])) if len(h) else h


class Chunk:
    """Tokens of a chunk by itself; ``at``/``token``: its first and last places, and how many tokens stand in front of each."""

    __slots__ = ("at", "token", "tokens")

    def __init__(self, text: str, tokens: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        if len(places) > 2 * PLACES:
            places = np.concatenate([places[:PLACES], places[-PLACES:]])
        self.tokens = tokens
        before = places
        if not text.isascii():
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            before = np.concatenate([[0], np.cumsum(width)])[places]
        ends = np.cumsum(sizes[tokens])
        token = np.searchsorted(ends, before) + 1
        good = ends[np.minimum(token, len(ends)) - 1] == before
        self.at, self.token = places[good].tolist(), token[good].tolist()


class Reuse:
    """Encodes texts, each distinct stretch once while the cache has room (then the older half goes)."""

    def __init__(self, path: str):
        self.enc = encoder(path)
        self.sizes = _token_sizes(path)
        self.chunks: dict[str, Chunk] = {}
        self.joins: dict[str, np.ndarray] = {}
        self.size = self.encoded = 0

    def tokens(self, text: str) -> np.ndarray:
        self.encoded += len(text)
        return np.array(self.enc.encode_ordinary(text), np.int32)

    def room(self, n: int) -> None:
        self.size += n
        if self.size > CACHE_CHARS:
            for d in (self.chunks, self.joins):
                for key in list(d)[: len(d) // 2]:
                    del d[key]
            self.size = sum(map(len, self.chunks)) + sum(map(len, self.joins))

    def chunk(self, text: str, places: np.ndarray) -> Chunk:
        got = self.chunks.get(text)
        if got is None:
            got = self.chunks[text] = Chunk(text, self.tokens(text), places, self.sizes)
            self.room(len(text))
        return got

    def stretch(self, text: str) -> np.ndarray:
        got = self.joins.get(text)
        if got is None:
            got = self.tokens(text)
            if len(text) < 1 << 10:
                self.joins[text] = got
                self.room(len(text))
        return got

    def repaired(self, left: Chunk | None, start: int, head: str, right: Chunk, tail: str) -> tuple[int | None, np.ndarray, int] | None:
        """(tokens of left in front of the stretch, tokens of the stretch, the place of right where it ends), or None if nothing agrees.

        ``head`` is the left text, of which the first ``start`` characters are done; the first number is None if the stretch begins there.
        """
        for m in range(2, len(right.at) + 1):
            a, keep, before = start, None, None
            if left is not None and m <= len(left.at) and left.at[-m] > start:
                a, keep = left.at[-m], left.token[-m]
                before = left.tokens[keep : left.token[1 - m]]
            got = self.stretch(head[a:] + tail[: right.at[m - 1]])
            after = right.tokens[right.token[m - 2] : right.token[m - 1]]
            if np.array_equal(got[len(got) - len(after) :], after) and (before is None or np.array_equal(got[: len(before)], before)):
                return keep, got, m - 1
        return None

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """(tokens, number of chunks) of each text."""
        lay = Layout(texts)
        first = np.searchsorted(lay.edges, lay.base)
        lo, hi = np.searchsorted(lay.places, lay.edges[:-1], "right"), np.searchsorted(lay.places, lay.edges[1:], "left")
        out = []
        for d, text in enumerate(texts):
            text, base = text or "", int(lay.base[d])
            parts: list[np.ndarray] = []
            # what is not in parts yet: the texts of ``raw``, or chunk ``left`` (text ``head``) from character ``start`` and token ``done`` on
            raw: list[str] = []
            left, head, start, done = None, "", 0, 0
            for c in range(first[d], first[d + 1]):
                begin, end = int(lay.edges[c]) - base, min(int(lay.edges[c + 1]) - base, len(text))
                if end <= begin:
                    continue
                tail, places = text[begin:end], lay.places[lo[c] : hi[c]] - lay.edges[c]
                places = places[places < end - begin]
                right = self.chunk(tail, places) if len(places) > 1 else None
                if right is not None and len(right.at) < 2:
                    right = None
                if right is not None and left is None and not raw:
                    left, head, start, done = right, tail, 0, 0
                    continue
                got = None if right is None else self.repaired(left, start, head if left is not None else "".join(raw), right, tail)
                if got is None:
                    if left is not None:
                        cut, keep = (left.at[-2], left.token[-2]) if left.at[-2] > start else (start, done)
                        parts.append(left.tokens[done:keep])
                        raw, left, start, done = [head[cut:]], None, 0, 0
                    raw.append(tail)
                    continue
                keep, tokens, place = got
                if keep is not None:
                    parts.append(left.tokens[done:keep])
                parts.append(tokens)
                raw, left, head, start, done = [], right, tail, right.at[place], right.token[place]
            if left is not None:
                parts.append(left.tokens[done:])
            elif raw:
                parts.append(self.tokens("".join(raw)))
            out.append((np.concatenate(parts) if parts else np.zeros(0, np.int32), int(first[d + 1] - first[d]) if text else 0))
        return out


@lru_cache(maxsize=2)
def _token_sizes(path: str) -> np.ndarray:
    enc = encoder(path)
    out = np.zeros(enc.n_vocab, np.int64)
    for b, r in enc._mergeable_ranks.items():
        out[r] = len(b)
    return out


def routed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), documents that share their smallest chunk in one partition; AQE splits one that is too large."""
    def route(batch: pa.RecordBatch) -> Iterator[dict]:
        keys = [Layout(texts, places=False).routes() for _, _, texts in text_slices(batch.column(1))]
        yield {"doc_id": batch.column(0), "text": batch.column(1), "route": np.concatenate(keys)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, route, "doc_id long, text string, route long").hint("rebalance", "route").select("doc_id", "text")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, n_chunks, round_trip): one row for each row; round_trip tells that decoding gives the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse = Reuse(vocabulary)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1)):
                got = reuse.encode_all(texts)
                null = np.array([t is None for t in texts])
                same = [t is None or reuse.enc.decode_bytes(g[0].tolist()) == t.encode("utf-8", "surrogatepass") for t, g in zip(texts, got, strict=True)]
                sizes = np.array([len(g[0]) for g in got])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                flat = pa.array(np.concatenate([g[0] for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], pa.ListArray.from_arrays(offsets, flat), pa.array(sizes.astype(np.int32), mask=null),
                        pa.array(np.array([g[1] for g in got], np.int32)), pa.array(same, mask=null),
                    ],
                    names=["doc_id", "tokens", "n_tokens", "n_chunks", "round_trip"],
                )
        del reuse
        give_back()

    return routed(docs, id_col, text_col).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, n_chunks int, round_trip boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text): the texts of token lists; null tokens give a null text."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = encoder(vocabulary)
        lists = batch.column(1).to_pylist()
        yield {"doc_id": batch.column(0), "text": [None if t is None else enc.decode_bytes(t).decode("utf-8", "replace") for t in lists]}

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    return map_arrow(rows, run, "doc_id long, text string")
